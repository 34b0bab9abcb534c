"""Merkle manifest of a dataset: content-addressed nodes, and proofs by descent from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.ranks import ranked
from tracegraph.llm.tables import quoted, saved

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The group of the tree over the sources; keys of sources are empty or start with KEY_MARK.
TOP = "/"
KEY_MARK = "+"

PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """What a leaf takes from a column: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a leaf, as hex text."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _node(children: Column) -> Column:
    """Digest of a node: that of its children's digests, one after the other."""
    return F.sha2(F.array_join(children, ""), 256)


def build(leaves: DataFrame, fan_out: int = FAN_OUT) -> tuple[list[DataFrame], DataFrame]:
    """Records of every level above the leaves, and the tops (key, digest, height).

    ``leaves`` has key, rank (gapless in a key), n (leaves of the key) and digest. While a key has several nodes,
    every ``fan_out`` consecutive ones become one. A level's records are (digest, children),
    each digest once, so equal subtrees are stored once. Groups never exceed ``fan_out``
    rows, whatever a key holds, and each level is a ``fan_out``-th of the one below.
    """
    level = leaves.select("key", F.col("rank").alias("idx"), "digest", "n")
    levels, tops = [], level.filter("n = 1").select("key", "digest", F.lit(0).alias("height"))
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda c: c["digest"])
        grown = level.filter("n > 1").groupBy("key", F.floor(F.col("idx") / fan_out).alias("idx")).agg(children.alias("children"), F.first("n").alias("n"))
        grown = grown.select("key", "idx", _node(F.col("children")).alias("digest"), F.ceil(F.col("n") / fan_out).alias("n"), "children")
        nodes = saved(grown, "nodes")
        levels.append(nodes.groupBy("digest").agg(F.first("children").alias("children")))
        level = nodes.drop("children")
        tops = tops.unionByName(level.filter("n = 1").select("key", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // fan_out)
    return levels, saved(tops, "tops")


def _apart(children: Column, at: Column) -> Column:
    """The children left and right of a place, joined."""
    left, right = F.slice(children, F.lit(1), at), F.slice(children, at + 2, F.size(children))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def descend(levels: list[DataFrame], tops: DataFrame, requests: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """``requests`` (key, rank, request) with ``top`` and ``path``, the unselected children from a leaf up.

    ``tops`` has key, digest, height and path (what lies above, from the root down). All
    requests of a key start at its top. At every level the digest finds the record, the
    rank's digit selects a child, the others join the path, and requests that agree in
    their digits so far go on as one row; so the rows of a step number the nodes of its
    level at most, and the last level, whose rows are the requests, is unfolded in the task
    that holds the leaves' parent. The segments are reversed at the end.
    """
    starts = tops.select("key", "height", F.lit(0).cast("long").alias("idx"), "digest", F.col("digest").alias("top"), "path")
    wanted = {}
    if len(levels) > 1:
        wanted[1] = saved(requests.select("key", F.floor(F.col("rank") / fan_out).alias("child")).distinct(), "wanted")
    for height in range(2, len(levels)):
        wanted[height] = wanted[height - 1].select("key", F.floor(F.col("child") / fan_out).alias("child")).distinct()
    frontier = None
    for height in range(len(levels), 0, -1):
        here = starts.filter(F.col("height") == height).drop("height")
        frontier = here if frontier is None else frontier.unionByName(here)
        parents = frontier.join(levels[height - 1], "digest").select("key", "idx", "children", "top", "path")
        if height == 1:
            break
        asked = wanted[height - 1].groupBy("key", F.floor(F.col("child") / fan_out).alias("idx")).agg(F.collect_list("child").alias("wanted"))
        selected = parents.join(asked, ["key", "idx"]).withColumn("child", F.explode("wanted"))
        digit = (F.col("child") % fan_out).cast("int")
        frontier = saved(
            selected.select(
                "key", F.col("child").alias("idx"), F.get("children", digit).alias("digest"), "top",
                F.concat("path", F.array(_apart(F.col("children"), digit))).alias("path"),
            ),
            "frontier",
        )
    alone = starts.filter("height = 0").select("key", "top", "path")
    found = requests.join(alone, "key").select("key", "rank", "request", "top", F.reverse("path").alias("path"))
    if levels:
        block = requests.groupBy("key", F.floor(F.col("rank") / fan_out).alias("idx")).agg(F.collect_list(F.struct("rank", "request")).alias("asked"))
        last = parents.join(block, ["key", "idx"]).select("key", "children", "top", "path", F.explode("asked").alias("a"))
        path = F.reverse(F.concat("path", F.array(_apart(F.col("children"), (F.col("a.rank") % fan_out).cast("int")))))
        found = found.unionByName(last.select("key", "a.rank", "a.request", "top", path.alias("path")))
    return found


def proof_text(path: Column) -> Column:
    """The siblings of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, as hex text."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per input row: doc_id, source, leaf, subroot, root, path, folded_root, verified.

    ``fields`` name the identifier, the source and what else a leaf covers, the text last.
    A leaf is the digest of all of them. Per source the leaves ascend by identifier (nulls
    first; rows that share one by their leaf) and form a tree; the sources' trees, null
    first, then by the bytes of their name, form another whose top is the root.
    ``path`` has the siblings from the leaf to the root. ``folded_root`` is what the path
    makes of a leaf read with ``tampered`` in place of the text (default: as it is);
    ``verified`` says whether that is the root. Rows that agree in everything are leaves
    next to each other and get a row each; other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    columns = [quoted(c) for c in fields]
    other = columns[-1] if tampered is None else tampered
    own, changed = leaf_digest(columns), leaf_digest([*columns[:-1], other])
    key = F.coalesce(F.concat(F.lit(KEY_MARK), columns[1].cast("string")), F.lit(""))
    rows = docs.select(
        columns[0].alias("doc_id"), columns[1].alias("source"), key.alias("key"), own.alias("digest"),
        F.when(~other.eqNullSafe(columns[-1]), changed).alias("changed"),
    )
    leaves = saved(ranked(rows, "key", ["doc_id", "digest"], "rank", "n"), "leaves")
    levels, subroots = build(leaves, fan_out)

    named = saved(ranked(subroots.select(F.lit(TOP).alias("top"), "key", "digest", "height"), "top", ["key"], "rank", "n"), "subroots")
    upper, root = build(named.select(F.col("top").alias("key"), "rank", "digest", "n"), fan_out)
    request = F.struct("key", "digest", "height").alias("request")
    starts = descend(upper, root.withColumn("path", F.array().cast(PATH)), named.select(F.col("top").alias("key"), "rank", request), fan_out)
    tops = starts.select("request.*", F.reverse("path").alias("path"))

    request = F.struct("doc_id", "source", "digest", "changed").alias("request")
    found = descend(levels, tops, leaves.select("key", "rank", request), fan_out)
    # One value, whatever the tables hold.
    whole = root.select("digest").first()
    proved = found.select("request.*", "top", "path")
    folded = fold(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root")
    out = proved.select(
        "doc_id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"),
        F.lit(whole[0] if whole else None).cast("string").alias("root"), "path", folded,
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
