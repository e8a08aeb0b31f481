"""URL filter: explicit rules, then a tree of path templates for each host.

Paths are cut into segments, and numbers, hashes and the like inside them become
wildcards. Equal templates are counted before any shuffle. The tree is then
walked from the root to its full depth, from one node with several branches to
the next: segments that all paths of a node share are passed at once. Some
branches differ by chance, the more the more there are: those whose shares of bad
labels differ from all the rest of their node together (likelihood ratio,
``CHANCE`` over all branches tested) stand out, whatever the node's width. Of
these, such as don't differ from each other (two-proportion z) are merged. The rest,
with the branches that have no labels, is one wildcard, or keeps its name if it
is a single branch. Python gets a node's different pairs of labels and bad
labels, which grow much slower than its branches. A template is rejected if its
share of bad labels, smoothed towards that of its host and, above it, of all
pages, is ``PURITY`` or more.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

Z = 1.96
#: Odds that any branch of a node is told apart by chance.
CHANCE = 0.05
SMOOTHING = 4.0
LEAST = 3
PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest of ``(verdict, host/path)`` that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Segments of a path with variable parts as wildcards."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit("<uuid>"))
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{12,}$"), F.lit("<hash>"))
        .when(F.length(s) > 60, F.lit("<long>"))
        .otherwise(F.regexp_replace(s, r"[0-9]+", "<n>")),
    )


def _alike(n: int, b: int, labelled: int, bad: int) -> bool:
    """Whether a share of ``bad`` in ``labelled``, the greater one, doesn't differ from ``b`` in ``n``."""
    pooled = (b + bad) / (n + labelled)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / labelled))
    return spread == 0 or (bad / labelled - b / n) / spread < Z


def merge_counts(counts: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the clusters for ``(labelled, bad, branches that have just these)``.

    Branches are sorted by their share of bad labels, and neighbours are joined
    while their shares don't differ.
    """
    out, n, b, number = [0] * len(counts), 0, 0, 0
    for i in sorted(range(len(counts)), key=lambda i: (counts[i][1] / counts[i][0], counts[i])):
        labelled, bad, many = counts[i]
        if n and not _alike(n, b, labelled, bad):
            n, b, number = 0, 0, number + 1
        n, b = n + many * labelled, b + many * bad
        out[i] = number
    return out


def stands_out(labelled: Column, bad: Column, all_labelled: Column, all_bad: Column, tested: Column) -> Column:
    """Whether a branch differs from all others of its node together, given how many branches are tested."""

    def gain(n: Column, b: Column) -> Column:
        part = lambda x, whole: F.when(x > 0, x * F.log(x * all_labelled / (n * whole))).otherwise(0.0)
        return part(b, all_bad) + part(n - b, all_labelled - all_bad)

    apart = gain(labelled, bad) + gain(all_labelled - labelled, all_bad - bad)
    return F.coalesce((labelled > 0) & (apart > F.log(tested * 2 / F.lit(CHANCE))), F.lit(False))


def _named(kids: DataFrame) -> DataFrame:
    """``(host, path, seg, name)`` for all branches ``kids`` (host, path, seg, labelled, bad)."""
    nodes = kids.groupBy("host", "path").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.count(F.when(F.col("labelled") > 0, 1)).alias("tested"))
    mixed = nodes.where((F.col("b") > 0) & (F.col("b") < F.col("n")))
    tested = kids.join(mixed, ["host", "path"])
    own = checkpoint(tested.where(stands_out(*map(F.col, ("labelled", "bad", "n", "b", "tested")))).select("host", "path", "seg", "labelled", "bad"))

    @F.arrow_udf("array<struct<labelled:long,bad:long,cluster:int>>")
    def clustered(groups: pa.Array) -> pa.Array:
        out = []
        for counts in groups.to_pylist():
            found = merge_counts([(c["labelled"], c["bad"], c["many"]) for c in counts])
            out.append([{"labelled": c["labelled"], "bad": c["bad"], "cluster": k} for c, k in zip(counts, found)])
        return pa.array(out, pa.list_(pa.struct([("labelled", pa.int64()), ("bad", pa.int64()), ("cluster", pa.int32())])))

    counts = own.groupBy("host", "path", "labelled", "bad").agg(F.count("*").alias("many")).groupBy("host", "path")
    to = counts.agg(F.array_sort(F.collect_list(F.struct("labelled", "bad", "many"))).alias("counts")).select("host", "path", F.explode(clustered("counts")).alias("to"))
    told = own.join(to.select("host", "path", "to.*"), ["host", "path", "labelled", "bad"])
    names = told.groupBy("host", "path", "cluster").agg(F.min("seg").alias("first"), F.count("*").alias("size"))
    name = F.when(F.col("size") == 1, F.col("first")).otherwise(F.concat(F.lit("{"), "first", F.lit("|+"), (F.col("size") - 1).cast("string"), F.lit("}")))
    apart = told.join(names, ["host", "path", "cluster"]).select("host", "path", "seg", name.alias("name"))
    rest = kids.join(apart, ["host", "path", "seg"], "left")
    alone = rest.groupBy("host", "path").agg(F.count(F.when(F.col("name").isNull(), 1)).alias("alike"))
    other = F.when(F.col("alike") == 1, F.col("seg")).otherwise(F.lit("<*>"))
    return rest.join(alone, ["host", "path"]).select("host", "path", "seg", F.coalesce("name", other).alias("name"))


def _to_branches(tree: DataFrame) -> DataFrame:
    """``tree`` with every row's path taken on to the next node with several branches, or to its end.

    All are held against the greatest rest of their node. Where the first one
    leaves it is the branch; a rest that is a beginning of the greatest leaves
    nowhere.
    """
    far = tree.groupBy("host", "path").agg(F.max("rest").alias("far"))
    same = F.zip_with("rest", F.slice("far", F.lit(1), F.size("rest")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    apart = F.array_position(same, False)
    held = tree.join(far, ["host", "path"]).withColumn("apart", F.when(apart > 0, apart - 1)).drop("far")
    first = held.groupBy("host", "path").agg(F.min("apart").alias("first"))
    take = F.least(F.coalesce("first", F.size("rest")), F.size("rest")).cast("int")
    return held.join(first, ["host", "path"]).select(
        "host",
        "segs",
        "labelled",
        "bad",
        F.slice("rest", take + 1, F.size("rest")).alias("rest"),
        F.concat("path", F.slice("rest", F.lit(1), take)).alias("path"),
    )


def templates(pages: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(host, segs, template, labelled, purity)`` for the hosts and segments of ``pages`` (page_id, host, segs).

    ``labels`` is (page_id, bad boolean): several labels of a page are bad if
    one of them is; null labels don't count.
    """
    rows = pages.select("page_id", "host", "segs")
    if labels is None:
        rows = rows.withColumn("bad", F.lit(None).cast("boolean"))
    else:
        one = labels.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
        rows = rows.join(one, "page_id", "left")
    tree = checkpoint(
        rows.groupBy("host", "segs")
        .agg(F.count("bad").alias("labelled"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
        .withColumns({"rest": F.col("segs"), "path": F.array().cast("array<string>")})
    )

    done = None
    while True:
        deep = checkpoint(_to_branches(tree)).withColumn("seg", F.try_element_at("rest", F.lit(1)))
        ended = deep.where("seg is null").select("host", "segs", "labelled", "bad", "path")
        done = ended if done is None else done.unionByName(ended)
        deep = deep.where("seg is not null")
        if not deep.limit(1).count():
            break
        kids = deep.groupBy("host", "path", "seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        named = deep.join(_named(kids), ["host", "path", "seg"])
        path = F.concat("path", F.array("name"))
        tree = checkpoint(named.select("host", "segs", "labelled", "bad", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), path.alias("path")))
    tree = checkpoint(done.withColumn("template", F.concat(F.lit("/"), F.array_join("path", "/"))))
    whole = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).select(
        ((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("all_share")
    )
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("hn"), F.sum("bad").alias("hb"))
    hosts = hosts.join(F.broadcast(whole)).select("host", ((F.col("hb") + SMOOTHING * F.col("all_share")) / (F.col("hn") + SMOOTHING)).alias("host_share"))
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).join(hosts, "host")
    own = own.select("host", "template", F.col("n").alias("all_labelled"), ((F.col("b") + SMOOTHING * F.col("host_share")) / (F.col("n") + SMOOTHING)).alias("purity"))
    return tree.join(own, ["host", "template"]).select("host", "segs", "template", F.col("all_labelled").alias("labelled"), "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, template and purity (the bad share).

    The longest rule that fits decides; else a template with ``LEAST`` labels or
    more is blocked at a bad share of ``PURITY``, and all else is allowed. A
    null url, or one without ``://``, has an empty host and path and is judged
    like any other. Repeated rows stay; empty tables give no rows; other
    columns are ignored.
    """
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    cut = cut.withColumn("segs", segments(F.col("path"))).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    known = templates(cut, labels)
    blocked = (F.col("labelled") >= LEAST) & (F.col("purity") >= PURITY)
    return cut.join(known, ["host", "segs"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        "purity",
    )
