"""Merkle manifest of a dataset: a tree of each language's documents, a tree over those, and a proof of each leaf.

Every node is known by its coordinate (tree, level, place). All nodes are materialised; the
proof of a leaf needs the nodes whose coordinates follow from the leaf's place and the number
of nodes on each level. They are exploded, joined with the node table, put in order,
concatenated, and folded into a root again.

Leaves of one run share all that stands above it, and so do the runs below one node: coordinates
are exploded for the runs, LEVELS levels at a time, and each such part of a path is handed down
to the nodes below. So a node is looked up by at most ARITY ** LEVELS rows, the root's children too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import broadcast_if_few, settled
from braidlog.operators.scans import placed

#: Levels of a path that are looked up for one node.
LEVELS = 3
#: Trees that are broadcast at most; each has a few numbers and one path.
TREES = 10_000
#: The name of the tree over the languages; their own are NO_LANG, or LANG and the language, in the order of languages.
ROOT, NO_LANG, LANG = "2", "0", "1"


def digest(*parts: Column) -> Column:
    """Lowercase hex of SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def part(value: Column) -> Column:
    """A value of a leaf: its number of UTF-8 bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    return digest(*(part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), part(text))


def levels(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, level, place, digest) and sizes (tree, level, n) of the trees over leaves (tree, place, digest).

    On each level every `arity` nodes, the last of them maybe fewer, make one of the next, until a tree has one.
    """
    nodes = settled(leaves.select("tree", F.lit(0).alias("level"), "place", "digest"))
    sizes = nodes.groupBy("tree").agg(F.lit(0).alias("level"), F.count("*").alias("n"))
    all_nodes, all_sizes = nodes, [sizes]
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = len(all_sizes)
        run = nodes.withColumn("run", F.floor(F.col("place") / arity)).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        # a tree that has come to one node stops: its only run is of that one, at its first place
        trees = broadcast_if_few(all_sizes[-1].where("n > 1").select("tree"), TREES)
        nodes = settled(run.join(trees, "tree", "left_semi").select("tree", F.lit(level).alias("level"), F.col("run").alias("place"), digest(F.array_join("nodes.digest", "")).alias("digest")))
        all_nodes = all_nodes.unionAll(nodes)
        all_sizes.append(all_sizes[-1].where("n > 1").select("tree", F.lit(level).alias("level"), F.ceil(F.col("n") / arity).alias("n")))
        most = -(-most // arity)
    sizes = all_sizes[0]
    for x in all_sizes[1:]:
        sizes = sizes.unionAll(x)
    return all_nodes, settled(sizes)


def _paths(nodes: DataFrame, sizes: DataFrame, above: DataFrame, arity: int, first: int) -> DataFrame:
    """(tree, place, path): of each node of level `first` that has levels above, what it is put together with up to the last root.

    above: (tree, path), what follows the root of a tree. path: array of (left, right), one for each level.
    """
    heights = sizes.groupBy("tree").agg(F.max("level").alias("height"))
    counted = sizes.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("sizes"))
    known = broadcast_if_few(settled(heights.join(counted, "tree").join(above, "tree")), TREES)
    top = heights.agg(F.max("height")).first()[0] or 0
    schema = "tree string, place bigint, path array<struct<left:string,right:string>>"
    upper = nodes.sparkSession.createDataFrame([], schema)
    for start in range(first + (max(top - first, 0) // LEVELS) * LEVELS, first - 1, -LEVELS):
        end = start + LEVELS
        anchors = nodes.where(F.col("level") == start).select("tree", "place").join(known.where(F.col("height") > start), "tree")
        of_level = F.explode(F.sequence(F.lit(start), F.least(F.col("height"), F.lit(end)) - 1)).alias("level")
        # the run that the path passes through on each level, from the place and the level's size
        spread = anchors.select("tree", "place", "sizes", of_level).withColumn("own", F.floor(F.col("place") / F.pow(F.lit(arity), F.col("level") - start)).cast("long"))
        begin = F.floor(F.col("own") / arity) * arity
        siblings = F.array_remove(F.sequence(begin, F.least(begin + arity, F.element_at("sizes", F.col("level"))) - 1), F.col("own"))
        wanted = spread.select("tree", F.col("place").alias("anchor"), "level", "own", F.explode(siblings).alias("place"))
        found = wanted.join(nodes, ["tree", "level", "place"]).groupBy("tree", "anchor").agg(F.array_sort(F.collect_list(F.struct("level", "place", "own", "digest"))).alias("found"))
        side = lambda level, left: F.array_join(F.transform(F.filter("found", lambda s: (s["level"] == level) & ((s["place"] < s["own"]) if left else (s["place"] > s["own"]))), lambda s: s["digest"]), "")
        # a level whose run is one node alone has no siblings, but its step
        steps = F.transform(F.sequence(F.lit(start), F.least(F.col("height"), F.lit(end)) - 1), lambda level: F.struct(F.coalesce(side(level, True), F.lit("")).alias("left"), F.coalesce(side(level, False), F.lit("")).alias("right")))
        own = anchors.join(found.withColumnRenamed("anchor", "place"), ["tree", "place"], "left").select("tree", "place", "height", F.col("path").alias("above"), steps.alias("steps"))
        last = own.where(F.col("height") <= end).select("tree", "place", F.concat("steps", "above").alias("path"))
        parent = F.floor(F.col("place") / arity**LEVELS).alias("parent")
        more = own.where(F.col("height") > end).select("tree", "place", parent, "steps").join(upper.select("tree", F.col("place").alias("parent"), "path"), ["tree", "parent"]).select("tree", "place", F.concat("steps", "path").alias("path"))
        upper = settled(last.unionAll(more))
    return upper


def manifest(docs: DataFrame, tampered: Column, arity: int = 8) -> DataFrame:
    """Per row of `docs` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof (array of left and
    right siblings, from the leaf up), proof_sha256, folded_root, verified.

    The leaf is a digest of the row's five values. A language's leaves stand by doc_id (null
    first), those of equal ids by digest; every `arity` of them become a node, and so on up to its
    subroot; subroots by language (null first, by bytes) become the root alike. folded_root is
    made from the leaf, or, where `tampered` is not null, from the leaf that this text gives, and from the
    siblings; verified tells whether it is the root. Repeated rows are leaves of their own.
    An empty table gives no rows; other columns are ignored; texts are hashed where they are read and never move.
    """
    leaves = docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), NO_LANG).otherwise(F.concat(F.lit(LANG), F.col("lang").cast("string"))).alias("tree"),
        leaf_of(F.col("text")).alias("digest"),
        F.when(tampered.isNotNull(), leaf_of(tampered)).alias("other"),
    )
    leaves = settled(placed(settled(leaves), ["tree"], ["doc_id", "digest"]))
    nodes, sizes = levels(leaves, arity)
    subroots = settled(nodes.join(sizes.where("n = 1").select("tree", "level"), ["tree", "level"]).select("tree", F.col("digest").alias("subroot")))
    langs = settled(placed(subroots.withColumn("one", F.lit(1)), ["one"], ["tree"]).drop("one"))
    root_nodes, root_sizes = levels(langs.select(F.lit(ROOT).alias("tree"), "place", F.col("subroot").alias("digest")), arity)
    root = settled(root_nodes.join(root_sizes.where("n = 1").select("level"), "level").select(F.col("digest").alias("root")))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    of_langs = _paths(root_nodes, root_sizes, root_sizes.select("tree").distinct().withColumn("path", nothing), arity, 0)
    above = langs.join(of_langs.select("place", "path"), "place", "left").select("tree", F.coalesce("path", nothing).alias("path"))
    of_runs = _paths(nodes, sizes, above, arity, 1)
    # a run's leaves have each other
    runs = leaves.withColumn("run", F.floor(F.col("place") / arity)).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "doc_id", "other"))).alias("members"))
    lone = sizes.where("level = 0").select("tree", (F.col("n") == 1).alias("lone"))
    of_trees = broadcast_if_few(lone.join(subroots, "tree"), TREES)
    small = sizes.groupBy("tree").agg(F.max("level").alias("height")).where("height <= 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("place"), "path")
    upper = of_runs.unionAll(small)
    joined = runs.join(upper.withColumnRenamed("place", "run"), ["tree", "run"]).join(of_trees, "tree").withColumn("member", F.explode("members"))
    beside = lambda left: F.array_join(F.transform(F.filter("members", lambda s: (s["place"] < F.col("member.place")) if left else (s["place"] > F.col("member.place"))), lambda s: s["digest"]), "")
    own = F.when(F.col("lone"), nothing).otherwise(F.array(F.struct(beside(True).alias("left"), beside(False).alias("right"))))
    rows = joined.select(F.col("member.doc_id").alias("doc_id"), F.col("member.digest").alias("leaf"), F.col("member.other").alias("other"), "subroot", F.concat(own, "path").alias("proof"))
    folded = F.aggregate("proof", F.coalesce("other", "leaf"), lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))
    shown = F.sha2(F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), ""), 256)
    top = root.first()
    root = F.lit(top["root"] if top else None).cast("string").alias("root")
    return rows.select("doc_id", "leaf", "subroot", root, "proof", shown.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
