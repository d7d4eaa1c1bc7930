"""Documents that share enough of their word shingles, joined exactly.

Copies of a word sequence are one class. A pair at the threshold shares a shingle among the first
n - ceil(threshold * n) + 1 shingles of each, in any order that all documents keep. The order used:
first the shingles in the lowest part of the hash range, rarest first, then the others by hash, and
last the heavy ones, a bounded list found on a bounded sample. How many classes hold a shingle is
counted for the lowest part alone; a class whose shingles that nobody shares fill its prefix has no
partner. Classes that share a shingle of their prefixes form candidate groups. In a large group most
of these shingles are shared by chance: its classes are compared where they meet, by sizes and by
bitmaps that no similar pair differs in too much, and it falls into the groups of what is left.
Groups are checked by signature trees: small ones together up to a bounded number of classes, large
ones first against a few hubs, in linear time, then in pairs of blocks, leaving pairs of blocks that
are already together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, give_back, raw, slices
from .components import components
from .signature_tree import linked, similar
from .words import sequence_prints, shingle_sets, word_hashes

WIDTH, PERCENT = 5, 75
#: Share of the hash range in which shingles are counted.
COUNTED = 0.36
SAMPLE_DOCS, HEAVY_SHARE, MOST_HEAVY = 20_000, 0.001, 400_000
#: Classes that one tree holds at most, and rounds of hubs for larger groups. A class counts once for every so many bytes of its set, or part of them.
TREE_ROWS, HUB_ROUNDS, CLASS_BYTES = 1024, 3, 1 << 16
#: Bits of the largest bitmap of a set, and classes that meet pair by pair at one shingle; up to FEW_MEET without a matrix.
MOST_BITS, MOST_MEET, FEW_MEET = 512, 256, 8
#: Rows of three numbers that are sent to every task at most.
MOST_BROADCAST = 100_000
_EDGE = np.uint64(int(COUNTED * 2**64))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(part: pa.RecordBatch):
    data, off = raw(part.column("text"))
    words, word_off = word_hashes(data, off)
    return shingle_sets(words, word_off, WIDTH), sequence_prints(words, word_off)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bitmap(s: np.ndarray) -> bytes:
    """A bit for each place that an odd number of the set's shingles falls on; of two such bitmaps no more bits differ than shingles."""
    bits = min(MOST_BITS, max(64, 1 << (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


class _Bitmaps:
    """Bitmaps and sizes of several sets; a larger bitmap is folded to the size of the smaller one."""

    def __init__(self, maps: list[bytes], size: np.ndarray):
        self.size, self.level = size, np.array([len(x) // 8 for x in maps], np.int64).reshape(-1)
        words = MOST_BITS // 64
        full = np.frombuffer(b"".join(x.ljust(8 * words, b"\0") for x in maps), np.uint64).reshape(len(maps), words)
        self.folded = {}
        while words:
            self.folded[words] = full
            words //= 2
            # what is no larger already stays
            full = np.where((self.level > words)[:, None], full[:, :words] ^ full[:, words:], full[:, :words]) if words else full

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs can have a Jaccard similarity of percent / 100; none that has it is left out."""
        m, n = self.size[i], self.size[j]
        ok = (100 * m >= percent * n) & (100 * n >= percent * m)
        level = np.minimum(self.level[i], self.level[j])
        for words, maps in self.folded.items():
            at = np.flatnonzero(ok & (level == words))
            apart = np.bitwise_count(maps[i[at]] ^ maps[j[at]]).sum(axis=1).astype(np.int64)
            ok[at] = (100 + percent) * apart <= (100 - percent) * (m[at] + n[at])
        return ok


def _heavy(documents: DataFrame) -> np.ndarray:
    """Shingles that more than HEAVY_SHARE of a sample's classes hold, sorted."""
    n = documents.count()
    if not n:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE_DOCS / n)
    sample = documents.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 30)) < share * (1 << 30))

    def tokens(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, (print_, _) = _sets(part)
                _, first = np.unique(print_, return_index=True)
                for i in range(0, len(first), 256):
                    some = first[i : i + 256]
                    hashes = np.concatenate([sets[k] for k in some]) if len(some) else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array(np.repeat(_signed(print_)[some], [len(sets[k]) for k in some]))], ["hash", "print"])

    least = max(8, int(HEAVY_SHARE * n * share))
    counts = sample.mapInArrow(tokens, "hash long, print long").distinct().groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "hash").limit(MOST_HEAVY).select("hash").toArrow()
    heavy = np.sort(np.asarray(found.column("hash").combine_chunks(), np.int64).view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)
    del found
    give_back()
    return heavy


def _outside(x: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.ones(len(x), bool)
    at = np.searchsorted(heavy, x)
    at[at == len(heavy)] = 0
    return heavy[at] != x


def shingle_components(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id for every row of documents.

    A null text, or one without words, has no shingles and links with nothing; a text of fewer
    than five words has one. Rows of equal word sequences are linked. Rows whose key is null get a
    component of null; rows that share a key are one document of several texts, linked by each. Very
    long texts are read whole, and their sets count by bytes where tasks are filled. An empty table
    gives an empty one. Other columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    documents = bounded_batches(documents).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    heavy = spark.sparkContext.broadcast(_heavy(documents.where(F.col("key").isNotNull())))

    def described(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, (p, q) = _sets(part)
                lights, more = [], []
                for s in sets:
                    light = _outside(s, heavy.value)
                    low = int((light & (s < _EDGE)).sum())
                    lack = max(0, _prefix(len(s), percent) - low) if len(s) else 0
                    rest = s[light & (s >= _EDGE)][:lack]
                    lights.append(low)
                    more.append(np.r_[rest, s[~light][: lack - len(rest)]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(_signed(p)), pa.array(_signed(q)), pa.array([len(s) for s in sets], pa.int64()), pa.array(lights, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array([_bitmap(s) for s in sets], pa.binary())],
                    ["key", "p", "q", "n", "lights", "more", "bitmap"],
                )

    kind = documents.schema["key"].dataType.simpleString()
    info = cut(documents.mapInArrow(described, f"key {kind}, p long, q long, n long, lights long, more array<long>, bitmap binary"))

    def counted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, (p, _) = _sets(part)
                _, first = np.unique(p, return_index=True)
                for i in range(0, len(first), 1024):
                    some = first[i : i + 1024]
                    low = [sets[k][sets[k] < _EDGE] for k in some]
                    low = [s[_outside(s, heavy.value)] for s in low]
                    hashes = np.concatenate(low)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array(np.repeat(_signed(p)[some], [len(s) for s in low]))], ["hash", "p"])

    tokens = documents.where(F.col("key").isNotNull()).mapInArrow(counted, "hash long, p long")
    # how many classes hold each counted shingle; copies in several batches repeat a row
    w = W.partitionBy("hash")
    shared = tokens.withColumn("least", F.min("p").over(w)).withColumn("most", F.max("p").over(w)).withColumn("df", F.count("*").over(w)).where(F.col("least") < F.col("most"))
    lists = shared.groupBy("p").agg(F.array_sort(F.collect_set(F.struct("df", "hash"))).alias("shared"))
    classes = info.where(F.col("key").isNotNull() & (F.col("n") > 0)).groupBy("p", "q").agg(F.min("key").alias("cid"), F.first("n").alias("n"), F.first("lights").alias("lights"), F.first("more").alias("more"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    classes = classes.join(lists, "p", "left").withColumn("shared", F.coalesce(F.transform("shared", lambda x: x["hash"]), F.array().cast("array<long>")))
    left = (length - (F.col("lights") - F.size("shared"))).cast("int")  # what the shingles that nobody shares leave of the prefix
    prefix = F.concat(F.slice("shared", F.lit(1), F.greatest(left, F.lit(0))), "more")
    cells = cut(classes.where(left > 0).select("cid", F.explode(prefix).alias("hash")))
    hubs = cells.groupBy("hash").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where(F.col("hub") < F.col("last")).select("hash", "hub")
    edges = cells.join(hubs, "hash").where(F.col("cid") != F.col("hub")).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    groups = components(edges.distinct()).select(F.col("id").alias("cid"), F.col("component_id").alias("grp"))
    groups = _parted(groups, cells, info.where(F.col("n") > 0).select(F.col("key").alias("cid"), "n", "bitmap"), kind, percent)

    def packed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, _ = _sets(part)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("grp"), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], ["cid", "grp", "tokens"])

    texts = documents.join(groups.withColumnRenamed("cid", "key"), "key")
    sets = cut(texts.select("key", "grp", "text").mapInArrow(packed, f"cid {kind}, grp {kind}, tokens binary"))
    links = _checked(sets, kind, percent)
    found = components(links).select(F.col("id").alias("cid"), "component_id")
    named = info.where(F.col("key").isNotNull() & (F.col("n") > 0)).groupBy("p", "q").agg(F.min("key").alias("cid"))
    joined = info.select("key", "p", "q", "n").join(_named(named, found), ["p", "q"], "left")
    component = F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.coalesce("class_component", "key")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    return classes.join(found, "cid", "left").select("p", "q", F.coalesce("component_id", "cid").alias("class_component"))


def _beside(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of `few` beside them, null where it has none.

    A key can have very many rows. `few` goes to every task if its number of rows is within
    MOST_BROADCAST, and rows are not moved; past that both are dealt by key, and Spark splits what
    is large.
    """
    fits = few.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(few) if fits else few, on, "left")


def _parted(groups: DataFrame, cells: DataFrame, bitmaps: DataFrame, kind: str, percent: int) -> DataFrame:
    """groups (cid, grp), the large ones parted into what may link where it meets; classes that may link with none are left out.

    cells: (cid, hash), a shingle of a prefix; two similar classes have one in common. bitmaps: (cid,
    n, bitmap), of each text of a class. At a shingle that very many classes hold they meet by size,
    and where these are too many still, all are joined.
    """
    groups = cut(groups)
    large = groups.groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") > TREE_ROWS // 2)
    large = cut(_beside(groups, cut(large), ["grp"]).where(F.col("m").isNotNull()).select("cid", "grp"))
    if not large.limit(1).count():
        return groups
    bitmaps = bitmaps.join(large.select("cid"), "cid", "left_semi").distinct()
    met = cells.join(bitmaps, "cid")
    held = cells.join(large.select("cid"), "cid", "left_semi").groupBy("hash").agg(F.count("*").alias("m"))
    met = _beside(met, cut(held.where(F.col("m") > MOST_MEET)), ["hash"])
    # sizes of two similar classes lie in the same step or in neighbouring ones
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent) or 1.0) + F.lit(1e-9))
    places = F.when(F.col("m").isNull(), F.array("hash")).otherwise(F.array(F.xxhash64("hash", step), F.xxhash64("hash", step + 1)))
    met = met.select("cid", "n", "bitmap", F.explode(places).alias("place"))
    full = cut(met.groupBy("place").agg(F.count("*").alias("m"), F.min("cid").alias("hub")).where(F.col("m") > MOST_MEET).select("place", "hub"))
    met = _beside(met, full, ["place"])
    joined = met.where(F.col("hub").isNotNull() & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b"))

    def meeting(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            place = np.asarray(table.column("place"))
            if not len(place):
                continue
            at = int(np.searchsorted(place, place[-1]))  # the last shingle's classes may go on in the next batch
            rest = table.slice(at).combine_chunks().to_batches()[0]
            if at:
                yield _may_links(table.slice(0, at), percent)
        if rest is not None:
            yield _may_links(pa.Table.from_batches([rest]), percent)

    by_place = met.where(F.col("hub").isNull()).select("cid", "n", "bitmap", "place").repartition("place").sortWithinPartitions("place")
    links = by_place.mapInArrow(meeting, f"a {kind}, b {kind}").unionByName(joined).where(F.col("a") != F.col("b")).distinct()
    parted = components(links).select(F.col("id").alias("cid"), F.col("component_id").alias("grp"))
    return groups.join(large.select("cid"), "cid", "left_anti").unionByName(parted)


def _may_links(table: pa.Table, percent: int) -> pa.RecordBatch:
    """a, b: links that join the classes of each place, whose rows stand together, which may be similar."""
    cid, place = table.column("cid").combine_chunks(), np.asarray(table.column("place"))
    maps = _Bitmaps(table.column("bitmap").to_pylist(), np.asarray(table.column("n")))
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[start, len(place)])
    own = np.repeat(count, count)
    left, right = [], []
    for step in range(1, FEW_MEET):
        i = np.flatnonzero((own[:-step] <= FEW_MEET) & (place[:-step] == place[step:])) if step < len(place) else np.zeros(0, np.int64)
        i = i[maps.may_link(i, i + step, percent)]
        left.append(i)
        right.append(i + step)
    for at, n in zip(start[count > FEW_MEET].tolist(), count[count > FEW_MEET].tolist(), strict=True):
        i, j = np.triu_indices(n, 1)
        ok = maps.may_link(at + i, at + j, percent)
        linked_ = np.eye(n, dtype=bool)
        linked_[i[ok], j[ok]] = linked_[j[ok], i[ok]] = True
        least, before = np.arange(n), None
        while before is None or (least != before).any():
            before, least = least, np.where(linked_, least[None, :], n).min(axis=1)
        i = np.flatnonzero(least != np.arange(n))
        left.append(at + i)
        right.append(at + least[i])
    left, right = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
    return pa.RecordBatch.from_arrays([cid.take(left), cid.take(right)], ["a", "b"])


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _checked(sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links (a, b) that join all classes of each group (cid, grp, tokens) that are connected."""
    weight = F.greatest(F.lit(1).cast("long"), F.ceil(F.length("tokens") / CLASS_BYTES))
    sizes = cut(sets.groupBy("grp").agg(F.sum(weight).alias("m")))
    # a large group's rows stay where they are: its size comes to them
    sized = _beside(sets, sizes.where(F.col("m") > TREE_ROWS // 2), ["grp"])
    small, large = sized.where(F.col("m").isNull()), sized.where(F.col("m").isNotNull())
    total = sizes.where(F.col("m") <= TREE_ROWS // 2).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bins = max(1, -(-2 * total // TREE_ROWS))

    def tree(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tokens, grp, cid = _arrays(table.column("tokens")), np.asarray(table.column("grp")), np.asarray(table.column("cid"))
        label = np.asarray(table.column("label"))
        order = np.lexsort((cid, [len(t) for t in tokens], grp))
        tokens = [tokens[i] for i in order]
        top = linked(tokens, label[order], percent)
        a, b = cid[order], cid[order][top]
        return pa.table({"a": a[a != b], "b": b[a != b]})

    binned = small.select("cid", "grp", "tokens", F.col("cid").alias("label"), F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("bin"))
    links = binned.groupBy("bin").applyInArrow(tree, f"a {kind}, b {kind}")
    if not large.limit(1).count():
        return links
    state = large.select("cid", "grp", "tokens", "m", F.col("cid").alias("label"))
    # a group is dealt out in even parts, and its hub sent to each of them
    parts = F.ceil(F.col("m") / (TREE_ROWS // 2)).cast("int")
    hub_links = None
    for _ in range(HUB_ROUNDS):
        hub = state.where(F.col("label") == F.col("cid")).groupBy("grp").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid", "tokens")).alias("hub"), F.first("m").alias("m"))
        hub = hub.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

        def against(batches):
            for batch in batches:
                hit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) if x is not None and y is not None else False for x, y in zip(batch.column("tokens").to_pylist(), batch.column("hub_tokens").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("grp"), batch.column("tokens"), batch.column("m"), batch.column("label"), batch.column("hub"), pa.array(hit)], ["cid", "grp", "tokens", "m", "label", "hub", "hit"])

        dealt = state.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(5)), parts).cast("int"))
        met = dealt.join(hub.select("grp", "part", F.col("hub.cid").alias("hub"), F.col("hub.tokens").alias("hub_tokens")), ["grp", "part"], "left")
        met = cut(met.select("cid", "grp", "tokens", "m", "label", "hub", "hub_tokens").mapInArrow(against, f"cid {kind}, grp {kind}, tokens binary, m long, label {kind}, hub {kind}, hit boolean"))
        new = met.where("hit").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
        hub_links = new if hub_links is None else hub_links.unionByName(new)
        state = met.select("cid", "grp", "tokens", "m", F.when(F.col("hit") & (F.col("label") == F.col("cid")), F.col("hub")).otherwise(F.col("label")).alias("label"))
    links = links.unionByName(hub_links)
    # what is together by now shares a label; blocks hold one label as far as they can
    together = components(hub_links).select(F.col("id").alias("cid"), F.col("component_id").alias("comp"))
    state = state.join(together, "cid", "left").select("cid", "grp", "tokens", "m", F.coalesce("comp", "cid").alias("label"))
    half = TREE_ROWS // 2
    per_label = state.groupBy("grp", "label").agg(F.sum(weight).alias("k")).where(F.col("k") >= half)
    # a label of its own for each block's worth of rows; the labels of fewer rows share blocks
    own = cut(per_label.select("grp", "label", F.ceil(F.col("k") / half).cast("int").alias("own")))
    rest = F.ceil(F.col("m") / half).cast("int")
    state = _beside(state, own, ["grp", "label"]).withColumn("pure", F.col("own").isNotNull())
    place = F.when(F.col("pure"), F.pmod(F.xxhash64("cid"), F.col("own"))).otherwise(F.pmod(F.xxhash64("cid", F.lit(9)), rest))
    state = state.withColumn("block", F.concat_ws(":", F.when(F.col("pure"), F.col("label").cast("string")).otherwise(F.lit("")), place.cast("string")))
    state = cut(state.select("cid", "grp", "tokens", "label", "pure", "block"))
    names = cut(state.groupBy("grp", "block").agg(F.first("label").alias("label"), F.first("pure").alias("pure")))
    pairs = names.alias("x").join(names.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") <= F.col("y.block")) & ~(F.col("x.pure") & F.col("y.pure") & (F.col("x.label") == F.col("y.label"))))
    pairs = pairs.select(F.col("x.grp").alias("grp"), F.col("x.block").alias("low"), F.col("y.block").alias("high"))
    sides = pairs.select("grp", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    tasks = state.join(sides, ["grp", "block"]).select("grp", "low", "high", "cid", "tokens", "label")
    return links.unionByName(tasks.groupBy("grp", "low", "high").applyInArrow(tree, f"a {kind}, b {kind}"))
