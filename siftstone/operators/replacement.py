"""Which library functions scanned code may replace, and where it does so first.

A model stands for a library function at a call: `name@path@root`, a dotted name, the calling file, and the name that the
call reaches it by. Entries say what files may replace at run time:

    any     any name of any module                    own     any name of the file's own module
    module  any name of the module `owner`            attr    `name` in the module `owner`

Each way a model may be hit is an equi-join: its path, its path and root, the prefixes of its owner (exploded), the parts
of its name (exploded). Each gives the earliest place, the least (path, line), by partial minima; the first way that
hits decides. Nothing is compared with every entry, and one entry's reach is its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "path string, line int, kind string, owner string, name string"


def prefixes(dotted: Column) -> Column:
    """a.b.c gives a, a.b and a.b.c; nothing for the empty name."""
    parts = F.filter(F.split(dotted, "\\."), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def suffixes(dotted: Column) -> Column:
    """a.b.c gives a.b.c, b.c and c."""
    parts = F.split(dotted, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The earliest place of each key, as `at`."""
    return rows.groupBy(*keys).agg(F.min(F.struct("path", "line")).alias("at"))


def scanned_modules(files: DataFrame) -> DataFrame:
    """(dotted, file): names that mean one scanned file, its module or a suffix that no other has. files: path, module."""
    named = files.select("path", "module", F.explode(suffixes(F.col("module"))).alias("dotted"))
    exact = F.col("dotted") == F.col("module")
    groups = named.groupBy("dotted").agg(F.min_by("path", F.struct(~exact, "path")).alias("file"), F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("exact"))
    return groups.filter("exact = 1 OR (exact = 0 AND n = 1)").select("dotted", "file")


def shadows(files: DataFrame) -> DataFrame:
    """(dotted, at): scanned files that are imported in place of a library module: those at a source root, not inside a package."""
    inside = F.endswith("path", F.lit("__init__.py")).cast("int")
    named = files.select("path", "module", F.split("path", "/").alias("_p"), inside.alias("_i"), F.posexplode(suffixes(F.col("module"))).alias("_n", "dotted"))
    depth = F.size(F.split("dotted", "\\.")) + F.col("_i")
    root = F.array_join(F.slice("_p", F.lit(1), F.greatest(F.size("_p") - depth, F.lit(0))), "/")
    named = named.select("path", "dotted", root.alias("root"))
    packages = files.filter(inside == 1).select(F.regexp_replace("path", "/?__init__\\.py$", "").alias("root"))
    kept = named.filter("root = ''").unionByName(named.filter("root <> ''").join(packages, "root", "left_anti"))
    return _first(kept.withColumn("line", F.lit(1)), "dotted")


def decided(models: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """(model, place): the models that scanned code may replace, each with the earliest place `path:line` of the first way that applies: anything, the caller's module, the name in it, a module in the library's stead, the function's name, its module."""
    part = lambda i: F.coalesce(F.get(F.split("model", "@"), i), F.lit(""))
    m = models.select("model").distinct().select("model", part(0).alias("dotted"), part(1).alias("caller"), part(2).alias("root"))
    parts = F.split("dotted", "\\.")
    owner = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    m = m.withColumn("owner", F.when(F.size(parts) > 1, owner).otherwise("builtins")).withColumn("names", F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts))
    known = scanned_modules(files)
    named = entries.filter("kind IN ('module', 'attr')").join(known, F.col("owner") == F.col("dotted"), "left").drop("dotted")
    # 1: everything; one row at most.
    every = entries.filter("kind = 'any'").agg(F.min(F.struct("path", "line")).alias("at"))
    # 2: the caller's module, written by itself or by name.
    own = entries.filter("kind = 'own'").select("path", "line", F.col("path").alias("caller")).unionByName(named.filter("kind = 'module' AND file IS NOT NULL").select("path", "line", F.col("file").alias("caller")))
    # 3: the name that the call uses, set in the caller's module from outside.
    attr = named.filter("kind = 'attr' AND file IS NOT NULL").select("path", "line", F.col("file").alias("caller"), F.col("name").alias("root"))
    # 4: modules in the library's stead, the shortest prefix of the owner first.
    by_prefix = m.filter("owner <> 'builtins'").select("model", F.posexplode(prefixes(F.col("owner"))).alias("n", "dotted"))
    shadow = by_prefix.join(shadows(files), "dotted").groupBy("model").agg(F.min_by("at", "n").alias("at"))
    # 5: the function, or a submodule on the way, by name.
    hit = m.select("model", F.posexplode("names").alias("n", "name")).join(_first(entries.filter("kind = 'attr'"), "name"), "name")
    by_name = hit.groupBy("model").agg(F.min_by("at", "n").alias("at"))
    # 6: its module, or one above it.
    modules = _first(entries.filter("kind = 'module'").withColumnRenamed("owner", "dotted"), "dotted")
    above = m.select("model", F.explode(F.array_union(prefixes(F.col("owner")), F.array(F.col("owner")))).alias("dotted")).join(modules, "dotted").groupBy("model").agg(F.min_by("at", "dotted").alias("at"))
    out = m.select("model", "caller", "root").join(F.broadcast(every.withColumnRenamed("at", "at1")))
    out = out.join(_first(own, "caller").withColumnRenamed("at", "at2"), "caller", "left").join(_first(attr, "caller", "root").withColumnRenamed("at", "at3"), ["caller", "root"], "left")
    for i, found in ((4, shadow), (5, by_name), (6, above)):
        out = out.join(found.withColumnRenamed("at", f"at{i}"), "model", "left")
    out = out.withColumn("at", F.coalesce(*[F.col(f"at{i}") for i in range(1, 7)])).filter("at IS NOT NULL")
    return out.select("model", F.concat_ws(":", "at.path", F.col("at.line").cast("string")).alias("place"))
