"""MinHash near-dedup with bottom-k sketches from one hash function.

Each distinct shingle set keeps its k smallest hashes. Inverted lists of these values generate candidate pairs, the rarest
values of a sketch first: sets of Jaccard J >= 0.8 share so many retained values that one of the rarest must be among them
(for sets larger than k but for a chance of about 1e-6). A union-sketch estimate filters the pairs and an exact Jaccard over
the full shingle sets confirms each link; links are joined to components.

Documents with equal sets are one class with one representative. A list of more than a few classes is split by set size, as
sets of 0.8 differ by a quarter in size at most; lists of the same members are one. What is still long is not expanded into
pairs. First every member is compared with the list's most central members; this joins nearly all that belongs together.
Members outside the component of their list's centre are then compared exactly with all members of other components, in pairs
of blocks of bounded size over the full shingle sets; a pair of blocks gives out a spanning forest of its links at most. So no
link between components is lost, and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, WordHashes, arrow_lists, gram_hashes, id_and_text, join_counted, map_batches, null_id, plain_id, stage
from .components import connected_components

SHINGLE = 4
SKETCH = 64
#: Retained values that two sketches of k share at least: 0.8 k less 4.75 standard deviations.
SHARED = 0.5625
#: The union-sketch estimate may fall short of the threshold by so much (4.5 standard deviations at k = 64).
SLACK = 0.225
#: Lists of up to so many classes are expanded into pairs.
COLD = 32
#: Members of a block when the rest of a long list is compared (a few MB of text).
BLOCK = 512
#: Sizes of linked sets differ by a factor of 1.25 at most, so they are in the same step of this width or in neighbouring ones.
STEP = 1.26


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of the whole word sequence if it is shorter."""
    words = text.encode().lower().split() if text else []
    return np.unique(gram_hashes(hashes.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def sketches(docs: DataFrame, n: int = SHINGLE, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, tk (a hash of the text), n_shingles, the set's 128-bit fingerprint (f1, f2) and its k smallest hashes, for each row."""

    def start():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch):
            sets = [shingles(t, hashes, n) for t in batch.column("text").to_pylist()]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
            return {
                "doc": batch.column("doc"), "tk": batch.column("tk"), "n_shingles": [len(s) for s in sets], "f1": prints[:, 0], "f2": prints[:, 1],
                "sketch": arrow_lists([s[:k].view(np.int64) for s in sets], pa.int64()),
            }

        return each

    rows = id_and_text(docs, id_col, text_col).select(plain_id().alias("doc"), F.xxhash64("text").alias("tk"), "text")
    return map_batches(rows, "doc long, tk long, n_shingles long, f1 long, f2 long, sketch array<long>", start)


def _prefixes(classes: DataFrame, k: int) -> DataFrame:
    """(value, df, node, n, hot): the rarest shared values of each sketch, enough of them to find every partner."""
    values = classes.select("node", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    shared = stage(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "values")
    lists = join_counted(values.withColumnRenamed("n", "size"), shared, ["value"]).withColumnsRenamed({"n": "df", "size": "n"})
    by_rarity = W.partitionBy("node").orderBy("df", "value")
    whole = W.partitionBy("node")
    ranked = lists.withColumns({
        "place": F.row_number().over(by_rarity) + F.col("held") - F.count("*").over(whole),
        "hot": F.count_if(F.col("df") > COLD).over(whole),
        "need": F.when(F.col("held") < k, F.ceil(F.col("held") * 0.8)).otherwise(F.lit(int(k * SHARED))),
    })
    return ranked.where("place <= held - need + 1").select("value", "df", "node", "n", "hot")


def _fitting(x: str, y: str):
    """Sizes that allow a Jaccard of 0.8."""
    return (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))


def _short_pairs(lists: DataFrame, on: list[str]) -> DataFrame:
    """All pairs of fitting sizes within short lists."""
    a, b = (lists.select(*on, F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, on).where((F.col("a") < F.col("b")) & _fitting("n_a", "n_b")).select("a", "b")


def _cells(hot: DataFrame) -> DataFrame:
    """(value, cell, node, n, hot, upper, members): long lists split by set size. A cell holds the members of one step of sizes and,
    marked upper, those of the next step, which are compared with the former only. Of cells with the same members one stays."""
    step = F.floor(F.log(F.col("size")) / F.log(F.lit(STEP))).cast("int")
    # a list whose sizes all fit each other is one cell
    spread = hot.groupBy("value").agg(F.count("*").alias("n"), (5 * F.min("n") >= 4 * F.max("n")).alias("even"))
    told = join_counted(hot.select("value", "node", F.col("n").alias("size"), "hot"), stage(spread, "spread"), ["value"])
    own, above = F.struct(step.alias("cell"), F.lit(False).alias("upper")), F.struct((step - 1).alias("cell"), F.lit(True).alias("upper"))
    split = told.select("value", "node", "size", "hot", F.explode(F.when(F.col("even"), F.array(F.struct(F.lit(-2).alias("cell"), F.lit(False).alias("upper")))).otherwise(F.array(own, above))).alias("c"))
    split = split.select("value", "node", "size", "hot", "c.cell", "c.upper")
    mark = F.xxhash64("node", "upper")
    about = split.groupBy("value", "cell").agg(
        F.count("*").alias("n"), F.count_if(~F.col("upper")).alias("own"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y")
    ).where("own > 0 and n > 1")
    one = about.groupBy("cell", "n", "x", "y").agg(F.min("value").alias("value")).select("value", "cell", "n")
    cells = join_counted(split, stage(one, "cells"), ["value", "cell"])
    return stage(cells.withColumnsRenamed({"n": "members", "size": "n"}), "cell-members")


def _star_pairs(cells: DataFrame) -> DataFrame:
    """Each member of a long cell with its two centres: the own member that holds the most common values, of all and of a quarter."""
    drawn = F.pmod(F.xxhash64("node"), F.lit(4)) == 0
    best = F.struct("hot", (-F.col("node")).alias("minus"), "n")
    own = F.when(~F.col("upper"), best)
    centres = cells.groupBy("value", "cell").agg(F.max(own).alias("one"), F.max(F.when(drawn, own)).alias("two"), F.count("*").alias("n"))
    centres = centres.select("value", "cell", "n", F.array_distinct(F.array_compact(F.array("one", "two"))).alias("centres"))
    members = cells.select("value", "cell", "node", F.col("n").alias("size"))
    stars = join_counted(members, stage(centres, "centres"), ["value", "cell"]).select("node", "size", F.explode("centres").alias("c"))
    stars = stars.select("node", F.col("size").alias("n"), (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("n_c"))
    stars = stars.where((F.col("node") != F.col("centre")) & _fitting("n", "n_c"))
    return stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def _attached(pairs: DataFrame, table: DataFrame, column: str, alias: str) -> DataFrame:
    """pairs with a column of table (by node) for either side; a node of many pairs is dealt out."""
    for x in "ab":
        asked = pairs.groupBy(x).agg(F.count("*").alias("n"))
        keys = table.select(F.col("node").alias(x), F.col(column).alias(f"{alias}_{x}")).join(asked, x)
        pairs = join_counted(pairs, keys, [x], wide=True).drop("n")
    return pairs


def _estimated(pairs: DataFrame, sketch_of: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs whose union sketch does not rule out the threshold."""
    pairs = _attached(pairs, sketch_of, "sketch", "sketch")

    def start():
        def each(batch: pa.RecordBatch):
            good = []
            for p, q in zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True):
                x, y = p.values.to_numpy().view(np.uint64), q.values.to_numpy().view(np.uint64)
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:][both[1:] == both[:-1]]
                union = np.unique(both)
                if len(x) < k and len(y) < k:
                    good.append(100 * len(twice) >= 100 * threshold * len(union) - 1e-9)
                else:
                    edge = union[min(k, len(union)) - 1]
                    good.append((twice <= edge).sum() >= (threshold - SLACK) * min(k, len(union)))
            mask = pa.array(good)
            return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return each

    return map_batches(pairs, "a long, b long", start)


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union over the full sets."""
    pairs = _attached(pairs, texts, "packed", "text")

    def start():
        hashes, unpack, kept = WordHashes(), zstandard.ZstdDecompressor(), {}

        def shingle_set(node: int, packed: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[node] = shingles(unpack.decompress(packed).decode(), hashes, n)
            return kept[node]

        def each(batch: pa.RecordBatch):
            good = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                x, y = shingle_set(a, ta), shingle_set(b, tb)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(good)
            return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return each

    return map_batches(pairs, "a long, b long", start)


def _forest(table: pa.Table, n: int, percent: int) -> pa.Table:
    """A spanning forest of the links between two blocks: rows with side 0 (members outside the centre's component) against
    all rows of another label."""
    hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
    node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
    ys, xs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(ys) or not len(xs):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sets = [shingles(unpack.decompress(t).decode(), hashes, n) for t in table.column("packed").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    seen_y, seen_x = (np.unique(np.concatenate([sets[i] for i in those])) for those in (ys, xs))
    shared = np.intersect1d(seen_y, seen_x, assume_unique=True)
    met = np.zeros((len(ys), len(xs)), np.float32)
    for at in range(0, len(shared), 4096):  # so many columns at a time
        part = shared[at : at + 4096]
        left, right = (np.zeros((len(those), len(part)), np.float32) for those in (ys, xs))
        for grid, those in ((left, ys), (right, xs)):
            for row, i in enumerate(those):
                own = sets[i]
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], side="right")]
                where = np.minimum(np.searchsorted(part, own), len(part) - 1)
                grid[row, where[part[where] == own]] = 1
        met += left @ right.T
    links = (100 * met >= percent * (sizes[ys][:, None] + sizes[xs][None, :] - met)) & (label[ys][:, None] != label[xs][None, :])
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    a, b = [], []
    for i, j in zip(*np.nonzero(links), strict=True):
        p, q = root(int(label[ys[i]])), root(int(label[xs[j]]))
        if p != q:
            parent[q] = p
            a.append(int(node[ys[i]]))
            b.append(int(node[xs[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _supported(rows: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node): those whose shingles in more than one component make up the threshold. A node without them, for instance one that
    shares only a common passage, has no link to another component.

    Nodes of a component lie side by side in packs of some megabytes of text, ranges of (label, node), and a pack asks once for each shingle
    that its nodes hold: what is shuffled are the distinct shingles of packs, not those of nodes.
    """
    pack = "pack long, nodes array<long>, ends array<int>, members array<int>, shingles array<long>, lo array<long>, hi array<long>"

    def start():
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch):
            sets = [shingles(unpack.decompress(t).decode(), hashes, n).view(np.int64) for t in batch.column("packed").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            values, members = np.unique(np.concatenate(sets), return_inverse=True)
            labels = np.repeat(batch.column("label").to_numpy(), sizes)
            lo, hi = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
            np.minimum.at(lo, members, labels)
            np.maximum.at(hi, members, labels)
            nodes, one = batch.column("node").to_numpy(), lambda a, kind=None: arrow_lists([a], kind or pa.int64())
            return {"pack": nodes[:1], "nodes": one(nodes), "ends": one(np.cumsum(sizes), pa.int32()), "members": one(members, pa.int32()), "shingles": one(values), "lo": one(lo), "hi": one(hi)}

        return each

    nodes = rows.groupBy("node").agg(F.first("label").alias("label"))
    packs = stage(map_batches(nodes.join(texts, "node").repartitionByRange("label", "node"), pack, start), "packs")
    seen = packs.select(F.explode(F.arrays_zip("shingles", "lo", "hi")).alias("x")).groupBy(F.col("x.shingles").alias("shingle"))
    seen = seen.agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.count("*").alias("n"))
    shared = stage(seen.where("lo < hi").select("shingle", "n"), "shared")
    asked = packs.select("pack", F.explode("shingles").alias("shingle"))
    answers = join_counted(asked, shared, ["shingle"]).groupBy("pack").agg(F.collect_list("shingle").alias("shared"))

    def decide():
        def each(batch: pa.RecordBatch):
            good = []
            for nodes, ends, members, values, shared in zip(*(batch.column(c) for c in ("nodes", "ends", "members", "shingles", "shared")), strict=True):
                hit = np.isin(values.values.to_numpy(), shared.values.to_numpy())[members.values.to_numpy()]
                ends = ends.values.to_numpy()
                before = np.concatenate([[0], np.cumsum(hit)])
                starts = np.concatenate([[0], ends[:-1]])
                support = before[ends] - before[starts]
                good.append(nodes.values.to_numpy()[(support > 0) & (100 * support >= percent * (ends - starts))])
            return {"node": np.concatenate(good)}

        return each

    return map_batches(packs.join(answers, "pack").select("nodes", "ends", "members", "shingles", "shared"), "node long", decide)


def _rest_of_cells(cells: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components within the long cells, by pairs of blocks: members outside their centre's component with all others."""
    # a node is in a bounded number of cells, so it meets its label once
    by_node = cells.groupBy("node").agg(F.first("hot").alias("hot"), F.collect_list(F.struct("value", "cell", "upper")).alias("cells")).join(labels, "node", "left")
    rows = stage(by_node.select("node", "hot", F.coalesce("label", "node").alias("label"), F.explode("cells").alias("c")).select("node", "hot", "label", "c.*"), "labelled")
    # lists of one passage have nearly the same members: those whose smallest member (by hash) is the same are united
    about = rows.groupBy("value", "cell").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.xxhash64("node")).alias("least"))
    about = stage(about.where("lo <> hi").select("value", "cell", "least", "n"), "rest")
    rows = stage(join_counted(rows, about, ["value", "cell"]).select("cell", "least", "node", "label", "hot"), "rest-members")
    rows = stage(rows.join(_supported(rows, texts, n, percent), "node").select("cell", "least", "node", "label", "hot").distinct(), "united")
    best = F.struct("hot", (-F.col("node")).alias("minus"), "label")
    about = rows.groupBy("cell", "least").agg(F.max(best)["label"].alias("major"), F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    about = stage(about.where("lo <> hi").select("cell", "least", "major", "n"), "majors")
    rows = stage(join_counted(rows, about, ["cell", "least"]).withColumnRenamed("n", "members"), "mixed")
    outside = rows.where("label <> major").groupBy("cell", "least").agg(F.count("*").alias("outside"), F.first("members").alias("n"))
    rows = join_counted(rows, stage(outside, "outside"), ["cell", "least"])
    # members outside fill blocks of their own, so that the others travel once for each of these, mostly once in all
    sides = {"i_blocks": F.ceil(F.col("outside") / BLOCK).cast("int"), "j_blocks": F.ceil(F.col("members") / BLOCK).cast("int")}
    rows = rows.withColumns(sides).withColumn("at", F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rows.where("label <> major").select("cell", "least", F.pmod("at", "i_blocks").cast("int").alias("i"), each("j_blocks").alias("j"), "node", "label", F.lit(0).alias("side"))
    mates = rows.select("cell", "least", each("i_blocks").alias("i"), F.pmod("at", "j_blocks").cast("int").alias("j"), "node", "label", F.lit(1).alias("side"))
    both = stage(minor.union(mates), "blocks")
    asked = both.groupBy("node").agg(F.count("*").alias("n"))
    both = join_counted(both, texts.join(asked, "node"), ["node"], wide=True)
    pairs = both.groupBy("cell", "least", "i", "j").applyInArrow(lambda t: _forest(t, n, percent), "a long, b long")
    return pairs.distinct()


def _packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, zstd-compressed text) of the representatives in nodes (node, doc, tk)."""
    spark_rows = docs.where("text is not null").select(plain_id().alias("doc"), F.xxhash64("text").alias("tk"), "text")

    def start():
        pack = zstandard.ZstdCompressor(level=1)
        return lambda batch: {"doc": batch.column("doc"), "tk": batch.column("tk"), "packed": [pack.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    return map_batches(spark_rows, "doc long, tk long, packed binary", start).join(nodes, ["doc", "tk"]).dropDuplicates(["doc", "tk"])


def near_duplicates(docs: DataFrame, n: int = SHINGLE, k: int = SKETCH, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (xxhash64 of the text) for each row of docs.

    component_id is the smallest doc_id reachable over links. Texts without words (null, empty) have no shingles and link with
    nothing; a null doc_id comes before all others and its component reads null; rows that share a doc_id each link by their
    own text; repeated rows are copies; an empty table gives no rows; other columns are ignored.
    """
    docs = id_and_text(docs, id_col, text_col)
    rows = stage(sketches(docs, n, k), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min(F.struct("doc", "tk")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    classes = stage(classes.select("f1", "f2", "rep.doc", "rep.tk", "n", "sketch", "copies", F.monotonically_increasing_id().alias("node")), "classes")
    lists = stage(_prefixes(classes, k), "lists")
    cells = _cells(lists.where(F.col("df") > COLD))
    short, long = cells.where(F.col("members") <= COLD), cells.where(F.col("members") > COLD)
    pairs = _short_pairs(lists.where(F.col("df") <= COLD), ["value"]).union(_short_pairs(short, ["value", "cell"])).union(_star_pairs(long)).distinct()
    pairs = stage(_estimated(stage(pairs, "candidates"), classes.select("node", "sketch"), k, percent / 100), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(long.select("node")).distinct()
    texts = stage(_packed_texts(docs, classes.join(needed, "node").select("node", "doc", "tk")).select("node", "packed"), "texts")
    labels = connected_components(_confirmed(pairs, texts, n, percent))
    if not long.isEmpty():
        labels = stage(labels, "labels")
        rest = _rest_of_cells(long, labels, texts, n, percent)
        for x in "ab":
            rest = rest.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}")), x, "left")
        # the links that are left join whole components, so their graph is that of the labels
        joined = stage(connected_components(rest.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))), "joined")
        sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
        over = joined.select(F.col("node").alias("label"), F.col("label").alias("top")).join(sizes, "label")
        labels = join_counted(labels, over, ["label"], "left").select("node", F.coalesce("top", "label").alias("label")).union(joined.join(labels.select("node"), "node", "left_anti"))
    named = stage(classes.join(labels, "node", "left").select("f1", "f2", "copies", "doc", F.coalesce("label", "node").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("doc").alias("component"), F.count("*").alias("n"))
    of_class = join_counted(named, smallest, ["label"]).select("f1", "f2", "component", F.col("copies").alias("n"))
    out = join_counted(rows.select("doc", "tk", "n_shingles", "f1", "f2"), stage(of_class, "components"), ["f1", "f2"], "left")
    out = out.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")))
    return out.select(
        null_id("doc").alias("doc_id"), "n_shingles", null_id("component").alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"), F.col("tk").alias("text_key"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest doc_id of each group.

    A row stored twice under one doc_id with one text stays once; other texts under that doc_id stay or go by their own group;
    texts without words have no group and stay.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    keys = kept.select(plain_id().alias("__doc"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumns({"__doc": F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)), "__key": F.xxhash64(docs[text_col].cast("string"))})
    return keyed.join(keys, ["__doc", "__key"], "left_semi").dropDuplicates(["__doc", "__key"]).drop("__doc", "__key")


def op4_bottom_k_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[u.i : u.i + least(4, len(w)) - 1], ' ')) AS g
  FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ways JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)"""
