"""The scan: files to findings, linked across files, merged with other tools' reports, redacted, identified, exported."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.analyze import engine, rules, spans
from siftstone.functions import taxonomy, text
from siftstone.operators import dictionary, fixpoint, identity, merging, regions, replacement, reporting
from siftstone.sources.code import python_files
from siftstone.sources.config import Config, user_rules

FINDING = (
    "path string, rule_id string, vuln_class string, cwe array<string>, severity string, confidence int, status string, suppression string, message string, note string, "
    "start_line int, start_column int, end_line int, end_column int, function string, sink string, owner string, flow array<struct<kind:string,ref:string,safe:array<string>>>, models array<string>"
)
#: Begins the mark of a path that relies on a library function, and of one that relies on a function which may be replaced.
MODEL, ASSUMED = "~model:", "~assumed:"


def analyzed(files: DataFrame, rule_classes=rules.BUILT_IN) -> DataFrame:
    """(kind, value): tagged JSON rows of every file, one Python call a file. files: path, content.

    Files are small and their analysis is not, so they are dealt by number, not by bytes: a table of a million files may be one split.
    """
    chosen = list(rule_classes)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        own = rules.validated(chosen)
        for part in batches:
            rows = []
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if content is None:
                    rows.append(("error", '{"message": "unreadable", "path": %s}' % json.dumps(path)))
                else:
                    rows += engine.analyze(path, content, own)
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])

    return files.select("path", "content").repartition(tasks, "path").mapInArrow(run, "kind string, value string")


def of_kind(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of a kind; flows come as lists, so structs are read by position from JSON lists."""
    return rows.filter(F.col("kind") == kind).select(F.from_json("value", schema).alias("v")).select("v.*")




def atoms(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(functions, returns, calls with arguments, candidate flows) as plain relations. A part is (kind, ref, safe)."""
    fn = of_kind(rows, "function", "path string, name string, params array<string>, positional int")
    fn = fn.withColumn("module", text.module_name(F.col("path")))
    part = lambda p: F.struct(F.get_json_object(p, "$[0]").alias("kind"), F.get_json_object(p, "$[1]").alias("ref"), F.from_json(F.get_json_object(p, "$[3]"), "array<string>").alias("safe"))
    ret = of_kind(rows, "returns", "path string, name string, parts array<string>").select("path", "name", F.explode("parts").alias("p"))
    ret = ret.select("path", "name", part(F.col("p")).alias("p")).select("path", "name", "p.*")
    call = of_kind(rows, "call", "path string, owner string, site string, targets array<string>, args array<string>").filter(F.size("targets") == 1)
    call = call.select("path", "owner", "site", F.element_at("targets", 1).alias("target"), F.explode("args").alias("a"))
    call = call.select("path", "owner", "site", "target", F.get_json_object("a", "$[0]").alias("arg"), F.explode(F.coalesce(F.from_json(F.get_json_object("a", "$[1]"), "array<string>"), F.array().cast("array<string>"))).alias("p"))
    call = call.select("path", "owner", "site", "target", "arg", part(F.col("p")).alias("p")).select("path", "owner", "site", "target", "arg", "p.*")
    sink = rows.filter("kind = 'finding'").select(F.from_json("value", "path string, rule_id string, start_line int, start_column int, owner string, status string, vuln_class string, flow array<string>").alias("v")).select("v.*")
    sink = sink.filter("status = 'candidate'").select("path", "rule_id", "start_line", "start_column", "owner", "vuln_class", F.explode("flow").alias("p"))
    sink = sink.select("path", "rule_id", "start_line", "start_column", "owner", "vuln_class", F.get_json_object("p", "$[0]").alias("kind"), F.get_json_object("p", "$[1]").alias("ref"), F.from_json(F.get_json_object("p", "$[2]"), "array<string>").alias("safe"))
    return fn, ret, call, sink


#: Imports followed from a call to its function, at most.
IMPORT_DEPTH = 8


def resolved(calls: DataFrame, fn: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with the function they name: one of the same file, else by exact module, else by a module suffix that one module only has.

    A module has its functions and the names that it imports; those are followed to the function.
    """
    f = fn.select("path", "name", "module", "params", "positional")
    # Names relative to the root start with a dot, its modules' names do not.
    inside = lambda t: F.regexp_replace(t, r"^\.(?=.*\.)", "")
    calls = calls.withColumn("target", inside(F.col("target")))
    parts = F.split("module", "\\.")
    both = f.withColumn("origin", F.lit(None).cast("string")).unionByName(imports.select("path", "name", text.module_name(F.col("path")).alias("module"), inside(F.col("target")).alias("origin")), allowMissingColumns=True)
    names = both.select("path", "name", "params", "positional", "origin", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"), "module")
    names = names.withColumn("dotted", F.concat("suffix", F.lit("."), "name"))
    unique = names.groupBy("dotted").agg(
        F.min_by(F.struct("path", "name", "params", "positional", "origin"), F.when(F.col("suffix") == F.col("module"), 0).otherwise(1)).alias("f"), F.countDistinct("path").alias("n"), F.count_if(F.col("suffix") == F.col("module")).alias("exact")
    ).filter("exact = 1 OR n = 1")
    unique = fixpoint.stored(unique.select("dotted", "f"))
    passed = unique.filter("f.origin IS NOT NULL").select("dotted", F.col("f.origin").alias("origin"))
    unique = delta = unique.filter("f.origin IS NULL")
    for _ in range(IMPORT_DEPTH):
        delta = fixpoint.stored(passed.join(delta.select(F.col("dotted").alias("origin"), "f"), "origin").select("dotted", "f"))
        if delta.isEmpty():
            break
        unique = unique.unionByName(delta)
    local = calls.join(f.select(F.col("path").alias("callee_path"), F.col("name").alias("callee"), "params", "positional"), (F.col("path") == F.col("callee_path")) & (F.col("target") == F.col("callee")))
    far = calls.join(unique, F.col("target") == F.col("dotted")).select(*calls.columns, F.col("f.path").alias("callee_path"), F.col("f.name").alias("callee"), F.col("f.params").alias("params"), F.col("f.positional").alias("positional"))
    both = local.select(*calls.columns, "callee_path", "callee", "params", "positional").unionByName(far)
    position = F.try_to_number("arg", F.lit("999999")).cast("int")
    param = F.when(position.isNotNull(), F.when(position < F.col("positional"), F.try_element_at("params", position + 1))).when(F.array_contains("params", F.col("arg")), F.col("arg"))
    return both.withColumn("param", param).filter("param IS NOT NULL").drop("params", "positional")


def replacements(rows: DataFrame) -> DataFrame:
    """What scanned code may replace, one row a place."""
    return of_kind(rows, "replaced", replacement.ENTRY)


def scanned(rows: DataFrame) -> DataFrame:
    """(path, module) of the analysed files."""
    return of_kind(rows, "file", "path string").select("path", text.module_name(F.col("path")).alias("module"))


def replaced_models(rows: DataFrame) -> DataFrame:
    """(mark, assumed, place): of all marks of library functions, those that scanned code may replace, with what is then assumed of the path and where that is seen first."""
    safe = F.array().cast("array<string>")
    _, ret, calls, sinks = atoms(rows)
    marks = None
    for df in (ret, calls, sinks):
        one = df.select(F.explode(F.coalesce("safe", safe)).alias("mark"))
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.unionByName(of_kind(rows, "finding", "models array<string>").select(F.explode("models").alias("mark"))).filter(F.startswith("mark", F.lit(MODEL))).distinct()
    models = fixpoint.stored(marks.select("mark", F.substring("mark", len(MODEL) + 1, 10_000).alias("model")))
    found = models.join(replacement.decided(models.select("model"), replacements(rows), scanned(rows)), "model")
    shown = F.concat(F.lit("`"), F.element_at(F.split("model", "@"), 1), F.lit("`, which scanned code may replace ("), "place", F.lit(")"))
    return fixpoint.stored(found.select("mark", F.concat(F.lit(ASSUMED), shown).alias("assumed"), shown.alias("shown")))


def decided(df: DataFrame, column: str, replaced: DataFrame) -> DataFrame:
    """df with the marks of library functions in an array column decided: those that nothing replaces go, and of the others one assumption stays, the least.

    Each distinct set of marks is worked out once.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn(column, F.coalesce(column, none))
    sets = df.select(F.col(column).alias("_set")).distinct().filter(F.exists("_set", lambda m: F.startswith(m, F.lit(MODEL))))
    least = sets.select("_set", F.explode("_set").alias("mark")).join(replaced, "mark", "left").groupBy("_set").agg(F.min("assumed").alias("_assumed"))
    plain = F.filter(F.col(column), lambda m: ~F.startswith(m, F.lit(MODEL)))
    joined = df.join(least, df[column] == least["_set"], "left")
    return joined.withColumn(column, merging.join_marks(plain, F.coalesce(F.array_compact(F.array("_assumed")), none))).drop("_set", "_assumed")


#: What names a finding before it has an id; steps told of a finding at most.
SINK = ["path", "rule_id", "start_line", "start_column"]
STEPS = 5


def label(atom: Column) -> Column:
    """A parameter or a call's result, in words."""
    part = lambda i: F.get(F.split(atom, r"\|"), i)
    return F.when(part(0) == "p", F.concat(F.lit("parameter `"), part(3), F.lit("` of `"), part(2), F.lit("` ("), part(1), F.lit(")"))).otherwise(F.concat(F.lit("the value returned at "), part(1), F.lit(":"), part(2)))


def linked(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Candidate sinks that input of another function reaches without being made safe for their class: SINK, origin, assumed, via, steps. origin: the least by a path of which nothing is assumed; assumed: what the least other path relies on; via: how that origin comes, the sink's own value first; steps: the first of all ways in, in order.

    Values flow through atoms: a parameter of a function, the result of a call site. Parameters join all call sites; a call
    site gets what its callee returns, and of the callee's parameters only what this site passes (summaries). Both parts are
    least fixpoints over finite sets, worked out from the new facts of each round.
    """
    fn, ret, calls, sinks = atoms(rows)
    ret, calls, sinks = (decided(df, "safe", replaced) for df in (ret, calls, sinks))
    imports = of_kind(rows, "import", "path string, name string, target string")
    calls = resolved(calls, fn, imports)
    # A call whose callee some file may replace links nothing; a file whose names may all be set links nothing either way.
    entries = replacements(rows)
    names = entries.filter("kind = 'attr'").select(F.col("name").alias("callee")).distinct()
    modules = replacement.scanned_modules(scanned(rows))
    open_files = entries.filter("kind = 'own'").select("path").unionByName(entries.filter("kind = 'module'").join(modules, F.col("owner") == F.col("dotted")).select(F.col("file").alias("path"))).distinct()
    anything = entries.filter("kind = 'any'").limit(1).select(F.lit(True).alias("any"))
    calls = calls.join(F.broadcast(anything), how="left").filter("any IS NULL").drop("any")
    calls = calls.join(open_files, "path", "left_anti").join(open_files.withColumnRenamed("path", "callee_path"), "callee_path", "left_anti")
    calls = fixpoint.stored(calls.join(names, "callee", "left_anti"))
    param_key = lambda p, f, n: F.concat_ws("|", F.lit("p"), p, f, n)
    ret_key = lambda p, s: F.concat_ws("|", F.lit("r"), p, s)
    marks = merging.join_marks
    none = F.array().cast("array<string>")
    # Summaries: (function) returns its parameter, through any depth of calls.
    seed = ret.filter("kind = 'param'").select("path", "name", F.col("ref").alias("param"), F.array_sort(F.coalesce("safe", none)).alias("safe"))
    through = ret.filter("kind = 'ret'").select("path", "name", F.col("ref").alias("site"), F.col("safe").alias("out_safe"))
    inner = calls.filter("kind = 'param'").select("path", F.col("owner").alias("name"), "site", "callee_path", "callee", F.col("param").alias("callee_param"), F.col("ref").alias("own"), F.col("safe").alias("arg_safe"))
    chain = fixpoint.stored(through.join(inner, ["path", "name", "site"]))

    def deeper(delta: DataFrame) -> DataFrame:
        d = delta.select(F.col("path").alias("callee_path"), F.col("name").alias("callee"), F.col("param").alias("callee_param"), F.col("safe").alias("s"))
        return chain.join(d, ["callee_path", "callee", "callee_param"]).select("path", "name", F.col("own").alias("param"), marks(marks(F.col("s"), F.coalesce("arg_safe", none)), F.coalesce("out_safe", none)).alias("safe"))

    summaries, _ = fixpoint.fixpoint(seed, deeper)
    # Edges between atoms, and the sources at atoms.
    own = F.when(F.col("kind") == "param", param_key(F.col("path"), F.col("owner"), F.col("ref"))).when(F.col("kind") == "ret", ret_key(F.col("path"), F.col("ref")))
    to_param = calls.select(own.alias("a"), "kind", "ref", "path", F.coalesce("safe", none).alias("safe"), param_key(F.col("callee_path"), F.col("callee"), F.col("param")).alias("b"))
    s = summaries.select(F.col("path").alias("callee_path"), F.col("name").alias("callee"), "param", F.col("safe").alias("s"))
    to_site = calls.join(s, ["callee_path", "callee", "param"]).select(own.alias("a"), "kind", "ref", "path", marks(F.coalesce("safe", none), F.col("s")).alias("safe"), ret_key(F.col("path"), F.col("site")).alias("b"))
    flows = to_param.unionByName(to_site)
    named = calls.select("callee_path", "callee", ret_key(F.col("path"), F.col("site")).alias("b")).distinct()
    returned = ret.select(F.col("path").alias("callee_path"), F.col("name").alias("callee"), "kind", "ref", F.coalesce("safe", none).alias("safe")).join(named, ["callee_path", "callee"])
    edges = flows.filter("a IS NOT NULL").select("a", "b", "safe").unionByName(returned.filter("kind = 'ret'").select(ret_key(F.col("callee_path"), F.col("ref")).alias("a"), "b", "safe"))
    edges = fixpoint.stored(edges.distinct())
    origin = F.concat_ws(": ", "path", "ref")
    none_before = [F.lit(None).cast("string").alias("from_b"), F.lit(None).cast("array<string>").alias("from_safe")]
    start = flows.filter("kind = 'source'").select("b", origin.alias("origin"), "safe").unionByName(returned.filter("kind = 'source'").select("b", F.concat_ws(": ", "callee_path", "ref").alias("origin"), "safe"))

    def onward(delta: DataFrame) -> DataFrame:
        e = edges.withColumnRenamed("safe", "edge_safe")
        d = delta.select(F.col("b").alias("a"), "origin", "safe")
        return d.join(e, "a").select("b", "origin", marks(F.col("safe"), F.col("edge_safe")).alias("safe"), F.col("a").alias("from_b"), F.col("safe").alias("from_safe"))

    fact = ["b", "origin", "safe"]
    values = fixpoint.witnessed(start.select("b", "origin", F.array_sort("safe").alias("safe"), *none_before), onward, fact)
    at = F.when(F.col("kind") == "param", param_key(F.col("path"), F.col("owner"), F.col("ref"))).otherwise(ret_key(F.col("path"), F.col("ref")))
    hit = sinks.withColumn("b", at).withColumnRenamed("safe", "own_safe").join(values.select(*fact), "b")
    hit = hit.withColumn("all", marks(F.col("safe"), F.coalesce("own_safe", none))).filter(~F.array_contains("all", F.col("vuln_class")))
    assumed = F.get(F.filter("all", lambda m: F.startswith(m, F.lit(ASSUMED))), 0)
    hit = fixpoint.stored(hit.withColumn("assumed", F.substring(assumed, len(ASSUMED) + 1, 10_000)))
    found = hit.groupBy(*SINK).agg(
        F.min(F.when(F.col("assumed").isNull(), F.struct(*fact))).alias("_sure"), F.min("assumed").alias("assumed")
    ).select(*SINK, F.col("_sure.origin").alias("origin"), "assumed", F.col("_sure.b").alias("b"), F.col("_sure.safe").alias("safe"))
    # The first steps of each sink, of all that reach it: the established ones, or what is assumed where there are none.
    step = F.when(F.col("assumed").isNull(), F.concat(F.lit("Modelled flow: untrusted "), "origin", F.lit(" reaches "), label(F.col("b")), F.lit("."))).otherwise(
        F.concat(F.lit("Untrusted "), "origin", F.lit(" may reach "), label(F.col("b")), F.lit(", but only through "), "assumed", F.lit(".")))
    every = hit.select(*SINK, F.col("assumed").isNull().alias("sure"), step.alias("step")).distinct()
    rank = F.row_number().over(Window.partitionBy(*SINK).orderBy(F.desc("sure"), "step"))
    firsts = every.withColumn("_n", rank).filter(F.col("_n") <= STEPS).groupBy(*SINK).agg(F.array_sort(F.collect_list(F.struct((~F.col("sure")).alias("open"), "step"))).alias("_s"))
    surely = F.transform(F.filter("_s", lambda x: ~x["open"]), lambda x: x["step"])
    firsts = firsts.select(*SINK, F.when(F.size(surely) > 0, surely).otherwise(F.transform("_s", lambda x: x["step"])).alias("steps"))
    # By which parameters and results the least established origin comes, the last first.
    done = fixpoint.traced(found, values, fact, ["from_b", "origin", "from_safe"], label(F.col("b")), STEPS)
    return done.drop("b", "safe").withColumnRenamed("trace", "via").join(firsts, SINK, "left")


def findings(rows: DataFrame, link: bool = True) -> DataFrame:
    """Findings with verdicts: those that rely on a library function which scanned code may replace are open again, linked ones confirmed."""
    schema = FINDING.replace("flow array<struct<kind:string,ref:string,safe:array<string>>>", "flow array<string>")
    f = of_kind(rows, "finding", schema).withColumn("sources", F.array(F.lit("siftstone"))).drop("flow", "owner")
    key = SINK
    replaced = replaced_models(rows)
    open_again = f.select(*key, F.explode("models").alias("mark")).join(replaced, "mark").groupBy(*key).agg(F.min("shown").alias("_shown"))
    f = f.join(open_again, key, "left")
    again = F.col("_shown").isNotNull() & ((F.col("status") == "confirmed") | (F.col("suppression") == "taint:sanitized"))
    f = f.withColumns({
        "note": F.when(again, F.concat(F.lit("the path relies on "), "_shown")).otherwise(F.col("note")),
        "confidence": F.when(again & (F.col("status") == "confirmed"), F.greatest(F.col("confidence") - 35, F.lit(0))).otherwise(F.col("confidence")),
        "suppression": F.when(again, F.lit(None).cast("string")).otherwise(F.col("suppression")),
        "status": F.when(again, "candidate").otherwise(F.col("status")),
    }).drop("_shown", "models")
    if not link or rows.filter("kind = 'call'").isEmpty():
        none = F.array().cast("array<string>")
        return f.withColumn("trace", none).withColumn("via", none)
    f = f.join(linked(rows, replaced), key, "left")
    confirm = F.col("origin").isNotNull() & (F.col("status") == "candidate")
    relies = F.col("origin").isNull() & F.col("assumed").isNotNull() & (F.col("status") == "candidate")
    return (
        f.withColumn("confidence", F.when(confirm, F.least(F.col("confidence") + 35, F.lit(100))).otherwise(F.col("confidence")))
        .withColumn("note", F.when(confirm, F.concat(F.lit("input gets there from "), "origin")).when(relies, F.concat(F.lit("input may get there by "), "assumed")).otherwise(F.col("note")))
        .withColumn("trace", F.when(confirm | relies, F.coalesce("steps", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
        .withColumn("via", F.when(confirm, F.col("via")).otherwise(F.array().cast("array<string>")))
        .withColumn("status", F.when(confirm, "confirmed").otherwise(F.col("status")))
        .drop("origin", "assumed", "steps")
    )


def merged(found: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Own and imported findings, overlapping ones of a class and file made one."""
    if imported is not None:
        more = imported.select("path", "rule_id", "vuln_class", "cwe", "severity", "confidence", F.lit("candidate").alias("status"), "message", F.lit("").alias("note"), "region.*", F.coalesce(F.col("sink") if "sink" in imported.columns else F.lit(None), F.lit("")).alias("sink"), (F.col("function") if "function" in imported.columns else F.lit(None).cast("string")).alias("function"), F.array("source").alias("sources"))
        found = found.unionByName(more, allowMissingColumns=True)
    # What each tool says; of an own finding also how input gets there.
    none = F.array().cast("array<string>")
    said = F.concat(F.element_at("sources", 1), F.lit(": "), F.when(F.coalesce("note", F.lit("")) != "", F.col("note")).otherwise(F.col("message")))
    found = found.withColumn("evidence", F.array_compact(F.concat(F.coalesce("trace", none), F.array(said))))
    big = F.lit(10_000_000)
    rows = found.withColumn("_s", F.col("start_line").cast("bigint") * big + F.col("start_column")).withColumn("_e", F.col("end_line").cast("bigint") * big + F.coalesce(F.col("end_column"), big - 1))
    rows = rows.withColumn("_e", F.greatest("_e", F.col("_s") + 1)).withColumn("_size", F.col("_e") - F.col("_s")).withColumn("_tool", F.element_at("sources", 1)).withColumn("_own", (F.col("_tool") != "siftstone").cast("int"))
    rows = rows.withColumn("_bucket", F.when(taxonomy.mergeable(F.col("vuln_class"), F.col("cwe")), F.lit("")).otherwise(F.concat_ws("|", "rule_id", F.col("_s").cast("string"))))
    rows = merging.cluster(rows, ["vuln_class", "path", "_bucket"], ["_size", "_s", "_own", "rule_id", "message"], "_s", "_e", "_tool", "sink")
    first = F.struct("_own", "rule_id", "_size", "_s", "message")
    rank = lambda c, order: F.max(F.struct(taxonomy.rank(F.col(c), order).alias("r"), F.col(c).alias("v")))["v"]
    return merged_clusters(rows, ["vuln_class", "path", "_bucket", "cluster"]).drop("_bucket", "cluster")


def merged_clusters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One finding a cluster. The primary is an own finding, else the one of the least rule; sink and function of the first that has one; the region covers all; evidence is joined with its repetitions; suppressed only if all are."""
    first = F.struct("_own", "rule_id", "_size", "_s", "message")
    rank = lambda c, order: F.max(F.struct(taxonomy.rank(F.col(c), order).alias("r"), F.col(c).alias("v")))["v"]
    some = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", first)).alias(c)
    end = regions.region_end(F.struct("start_line", "start_column", "end_line", "end_column"))
    suppressed = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "suppressed", F.col("suppression")))), ";")
    evidence = F.array_sort(F.flatten(F.collect_list(F.coalesce("evidence", F.array().cast("array<string>")))))
    out = rows.groupBy(*keys).agg(
        *[F.min_by(c, first).alias(c) for c in ("trace", "via", "rule_id", "message", "note")], some("sink"), some("function"),
        F.min(F.struct("start_line", "start_column")).alias("_from"), F.max(end).alias("_to"),
        rank("severity", taxonomy.SEVERITIES).alias("severity"), F.max("confidence").alias("confidence"), rank("status", taxonomy.STATUSES).alias("status"), suppressed.alias("suppression"), evidence.alias("evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), taxonomy.normalize_cwes(F.flatten(F.collect_list("cwe"))).alias("cwe"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
    )
    return out.select(
        *keys, "trace", "via", "rule_id", "message", "note", F.col("_from.start_line").alias("start_line"), F.col("_from.start_column").alias("start_column"), F.col("_to.line").alias("end_line"),
        F.when(F.col("_to.column") < float("inf"), F.col("_to.column").cast("int")).alias("end_column"), "function", F.coalesce("sink", F.lit("")).alias("sink"),
        F.when(F.col("status") == "suppressed", F.col("suppression")).alias("suppression"), "severity", "confidence", "status", "sources", "cwe", "rules", F.array_remove("rules", F.col("rule_id")).alias("related_rules"), "evidence",
    )


#: Texts of a finding that a reader sees.
SHOWN = ["rule_id", "function", "sink", "message", "note"]
#: Lists of texts that a reader sees.
LISTS = ["evidence", "trace", "via"]


def identified(found: DataFrame, secrets: DataFrame | None = None, tool: DataFrame | None = None) -> DataFrame:
    """Redacted and with ids. secrets (path, value, wide): of all files; wide ones are replaced in the findings of every file. tool: (value) of other tools."""
    clean = found
    if secrets is not None:
        known = secrets.filter("wide").select("value")
        # Lists ride as one text each, so that they are looked through like the others; no text holds the separator.
        clean = clean.withColumns({c: F.array_join(c, "\x1e") for c in LISTS})
        clean = dictionary.redacted(clean, [*SHOWN, *LISTS], known, "path", secrets.filter("NOT wide").select("path", "value"), tool)
        clean = clean.withColumns({c: F.filter(F.split(c, "\x1e"), lambda x: x != "") for c in LISTS})
    secret = F.col("vuln_class") == "secret"
    clean = clean.withColumn("sink", text.strip_controls(F.when(secret, text.redact_code(F.col("sink"), F.array().cast("array<string>"))).otherwise(F.col("sink"))))
    clean = clean.withColumn("message", text.strip_controls(F.when(secret, F.concat(F.lit("Possible hard-coded secret reported by "), F.array_join("sources", ", "), F.lit("."))).otherwise(F.col("message"))))
    order = [F.col(c) for c in ("start_line", "start_column", "rule_id", "message")]
    return identity.with_ids(clean, F.col("vuln_class"), F.col("path"), F.col("function"), F.col("sink"), order)


def file_secrets(rows: DataFrame) -> DataFrame:
    """(path, value, wide) of all analysed files."""
    return of_kind(rows, "secret", "path string, value string, wide boolean")


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), rule_classes=rules.BUILT_IN, imported: DataFrame | None = None, link: bool = True, tool_secrets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of the Python files below root."""
    rows = fixpoint.stored(analyzed(python_files(spark, root, ignore), rule_classes))
    if imported is not None:  # what is not scanned is not imported either
        imported = enriched(imported.filter(~text.ignored(F.col("path"), tuple(ignore))), python_files(spark, root, ignore))
    errors = of_kind(rows, "error", "path string, message string")
    secrets = file_secrets(rows)
    errors = dictionary.redacted(errors, ["message"], secrets.select("value"), tool=tool_secrets)
    return identified(merged(findings(rows, link), imported), secrets, tool_secrets), errors


def enriched(imported: DataFrame, files: DataFrame) -> DataFrame:
    """Imported rows (path, region, ...) with function and sink, where they have none: the innermost call that starts on the region's first line and holds its start column, of whole lines the last that starts there; else the line itself and the function around it.

    Only files with imported rows are parsed, and of those only what is on an asked line comes out.
    """
    asked = imported.select("path", F.col("region.start_line").alias("line")).distinct().groupBy("path").agg(F.collect_set("line").alias("lines"))
    kinds = "kind string, path string, line int, start int, end int, text string, function string"

    def run(batches):
        for part in batches:
            rows = [r for p, c, n in zip(*(part.column(i).to_pylist() for i in range(3))) for r in spans.spans(p, c, set(n))]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in kinds.split(", ")])

    found = fixpoint.stored(files.join(asked, "path").select("path", "content", "lines").mapInArrow(run, kinds))
    calls = found.filter("kind = 'call'").select("path", "line", "start", "end", F.struct("text", "function").alias("_call"))
    rows = imported.withColumns({"_line": F.col("region.start_line"), "_at": F.when(F.col("region.end_column").isNotNull(), F.col("region.start_column"))})
    rows = regions.innermost(rows, calls.withColumnRenamed("line", "_line"), ["path", "_line"], "_at", "start", "end", "_call", None)
    last = calls.groupBy("path", F.col("line").alias("_line")).agg(F.max(F.struct("start", (-F.col("end")).alias("end"), "_call"))["_call"].alias("_last"))
    rows = rows.join(last, ["path", "_line"], "left").withColumn("_call", F.when(F.col("_at").isNull(), F.col("_last")).otherwise(F.col("_call")))
    defs = found.filter("kind = 'def'").select("path", "start", "end", F.col("function").alias("_around"))
    rows = regions.innermost(rows, defs, ["path"], "_line", "start", "end", "_around", None)
    rows = rows.join(found.filter("kind = 'line'").select("path", F.col("line").alias("_line"), F.col("text").alias("_text")), ["path", "_line"], "left")
    has = lambda c: F.col(c) if c in imported.columns else F.lit(None).cast("string")
    sink = F.coalesce(F.nullif(has("sink"), F.lit("")), F.col("_call.text"), F.col("_text"), F.lit(""))
    function = F.coalesce(has("function"), F.when(F.col("_call").isNotNull(), F.col("_call.function")).otherwise(F.col("_around")))
    return rows.withColumns({"sink": sink, "function": function}).drop("_line", "_at", "_call", "_last", "_around", "_text")


def reported(found: DataFrame, settings: Config) -> DataFrame:
    """The findings that settings show, with `failing`: whether one makes the scan fail."""
    rank, suppressed = taxonomy.rank(F.col("severity"), taxonomy.SEVERITIES), F.col("status") == "suppressed"
    level = taxonomy.SEVERITIES.index
    shown = reporting.visible(rank, F.col("confidence"), suppressed, level(settings.min_severity), settings.min_confidence, settings.show_suppressed)
    return found.filter(shown).withColumn("failing", reporting.failing(rank, F.col("confidence"), suppressed, level(settings.fail_on), settings.min_confidence))


def scan_by_settings(spark: SparkSession, root: str, settings: Config, imported: DataFrame | None = None, tool_secrets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) as settings have it: what is ignored, which rules, whether files are linked, what is shown and what fails."""
    kinds = (*rules.BUILT_IN, *user_rules(settings.rules)) if settings.rules else rules.BUILT_IN
    found, errors = scan(spark, root, settings.ignore, kinds, imported, settings.link, tool_secrets)
    return reported(found, settings), errors


TEMPLATES = (
    'import os\n\n\ndef run_{k}(name):\n    os.system("echo " + name)\n\n\ndef main_{k}():\n    run_{k}(input())\n',
    'import sqlite3\nfrom flask import request\n\n\ndef find_{k}():\n    n = int(request.args["n"])\n    return sqlite3.connect("x").execute(f"select * from t where n = {{n}}")\n',
    'import hashlib\n\n\ndef digest_{k}(password):\n    return hashlib.md5(password.encode()).hexdigest()\n',
    'LIMIT = "{k}"\n\n\ndef code_{k}():\n    return eval(LIMIT)\n',
)


def demonstration(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Findings of one source file a part, made from templates by its key."""
    made = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        made = F.when(F.col("p_partkey") % len(TEMPLATES) == i, F.replace(F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))).otherwise(made)
    files = parts.select(F.concat(F.lit("app/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.encode(made, "UTF-8").alias("content"))
    rows = fixpoint.stored(analyzed(files))
    return identified(merged(findings(rows))).select("path", "rule_id", "vuln_class", "severity", "confidence", "status", "suppression", "start_line", "function", "id")
