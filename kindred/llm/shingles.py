"""N-gram Jaccard join by token-combination prefixes.

The tokens are a text's shingles, in the order of their hashes. Two sets that overlap in at least o tokens share k of
the first n - o + k of each. Every filter below is exact:

1. Each set is indexed under the n - o + k tokens of its extended prefix. A token that few sets hold is a key alone; the
   others are frequent. Sets of a rare key make pairs, and a pair stays if its rare tokens and the frequent ones that
   either set holds can be k together.
2. Only sets with k frequent tokens in their prefixes can be linked without a rare one. Their prefixes are extended to
   the whole set, and its tokens fall into classes by hash. A key is the combination of all tokens of a class. Linked
   sets differ in fewer tokens than there are classes, so some class has one combination in both.
3. Candidates are verified on whole sets.

Sets that share a combination are compared with one of them, the head. Those that this does not connect are compared
with the others below the head, but for those that their sizes, their distances from the head, or their tokens that the head or
no other set has rule out. So a group of near copies costs about as many comparisons as it has members, and still no
component is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, salted_join
from .session import forget, numbered, stored
from .text import mix, sliced, words_hashed

#: Sets that hold a frequent token at least. Rare tokens make at most FREQUENT * (FREQUENT - 1) / 2 pairs.
FREQUENT = 8
#: Times that sets without room for any link are left out; each time further tokens have one set only.
NARROWED = 2
#: Bits of the filter that tells which rows are read again.
WANTED_BITS = 1 << 25
#: Bits of a token by which it is indexed; whole tokens are compared when sets are verified.
TOKEN = np.uint64((1 << 48) - 1)

_SEED = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """Words of a shingle and the least Jaccard index, in percent."""

    words: int = 5
    percent: int = 80

    def overlap(self, n):
        """The least overlap of a set of n with any set that it is linked with; also the least size of such a set."""
        return -(-self.percent * n // 100)

    def extra(self, n: np.ndarray) -> np.ndarray:
        """k of the extended prefix, about a twentieth of the set."""
        return np.minimum(n // 20 + 1, self.overlap(n))

    def least_shared(self, n: Column) -> Column:
        """The least k of any set that a set of n can be linked with."""
        up = lambda x: F.ceil(x * F.lit(self.percent) / 100 - 1e-9)
        return F.least(F.floor(up(n) / 20) + 1, up(up(n)))

    def possible(self, n: Column, m: Column) -> Column:
        """Whether sets of n and m tokens can be linked at all."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def holds(self, common: Column, n: Column, m: Column) -> Column:
        """Whether an overlap, or at least as much, makes a link."""
        return common * 100 >= (n + m - common) * self.percent

    def room(self, common: Column, n: Column) -> Column:
        """Whether an overlap is enough for a link of a set of n with any other at all."""
        return common * 100 >= n * self.percent

    def grid(self, most: int) -> np.ndarray:
        """Sizes at which a new number of classes begins to serve: up to each one, that level's."""
        steps = [1]
        while steps[-1] < most:
            steps.append(max(steps[-1] + 1, int(steps[-1] * 1.42)))
        return np.array(steps, np.int64)

    def differences(self, least: np.ndarray) -> np.ndarray:
        """Tokens that are in one of two linked sets only, at most, if the smaller set has `least`."""
        return least * (100 - self.percent) // self.percent


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; one with fewer words has its whole sequence, one without none."""
    hashes, at = words_hashed(texts)
    n = len(hashes) - words + 1
    roll = np.zeros(max(0, n), np.uint64)
    for k in range(words):
        roll = mix(roll * _SEED + hashes[k : k + max(0, n)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(roll[a : b - words + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell sets apart."""
    both = np.frombuffer(b"".join([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)).view(np.int64)))


SetsOf = Callable[[list[bytes]], list[np.ndarray]]


def prefixes(like: Likeness, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set's extended prefix, as tokens of the index."""
    n = np.array([len(s) for s in sets], np.int64)
    length = n - like.overlap(n) + like.extra(n)
    return [s[:p] & TOKEN for s, p in zip(sets, length.tolist(), strict=True)]


def combinations(like: Likeness, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of each set's combinations: of all tokens of a class, for each number of classes that a link may need.

    A linked pair uses the classes that the smaller set's size asks for. They are some more than the pair can differ in,
    so that classes which are empty in both sets cannot be all that agree; a set with too many empty ones, which is
    hardly ever, has the tokens of its prefix as further keys, which hold among such sets only.
    """
    if not sets:
        return []
    grid = like.grid(max(len(s) for s in sets))
    of, level = [], []
    for i, s in enumerate(sets):
        if len(s):
            first, last = np.searchsorted(grid, [like.overlap(len(s)), len(s)])
            of += [i] * (last - first + 1)
            level += range(first, last + 1)
    of, level = np.array(of, np.int64), np.array(level, np.int64)
    most = like.differences(grid[level])
    spare = most // 4 + 2
    classes = most + 1 + spare
    n = np.array([len(sets[i]) for i in of], np.int64)
    tokens = np.concatenate([sets[i] for i in of])
    job = np.repeat(np.arange(len(of)), n)
    salted = mix(tokens ^ (level.astype(np.uint64) * _SEED + np.uint64(1))[job])
    chosen = ((salted >> np.uint64(32)) * classes.astype(np.uint64)[job] >> np.uint64(32)).astype(np.int64)
    begin = np.cumsum(classes) - classes
    place = begin[job] + chosen
    rank = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(place[rank]) != 0))
    sums = np.add.reduceat(mix(tokens * _SEED + np.uint64(7))[rank], edge)
    full = place[rank][edge]
    owner = job[rank][edge]
    keys = mix(sums + mix((level[owner] << 40 | (full - begin[owner])).astype(np.uint64)))
    empty = classes - np.bincount(owner, minlength=len(of))
    ends = np.searchsorted(owner, np.arange(len(of) + 1))
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for j, i in enumerate(of.tolist()):
        out[i].append(keys[ends[j] : ends[j + 1]])
        if empty[j] > spare[j]:
            out[i].append(mix(sets[i][: len(sets[i]) - like.overlap(len(sets[i])) + 1] ^ np.uint64(0x5EED)))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def _made(sets_of: SetsOf, of: Callable[[list[np.ndarray]], list[np.ndarray]] | None, wanted=None):
    """Rows (u, doc_id) with the sets of their texts: their sizes, two keys and, as `tokens`, what `of` makes of them.

    wanted: a filter of u; equal sets of a slice are told once.
    """

    def told(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = sets_of(texts)
        one, two = set_keys(sets)
        out = {c: part.column(c) for c in part.schema.names if c != "text"} | {"n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(one, pa.int64()), "h2": pa.array(two, pa.int64())}
        if of is None:
            return pa.RecordBatch.from_pydict(out)
        keep = np.sort(np.unique(np.column_stack([one, two]), axis=0, return_index=True)[1])
        keep = keep[[len(sets[i]) > 0 for i in keep.tolist()]] if len(keep) else keep
        found = pa.RecordBatch.from_pydict(out).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*found.columns, lists(of([sets[i] for i in keep.tolist()]))], [*found.schema.names, "tokens"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(_filtered(batches, wanted), "text", 2 << 20):
            yield told(part, texts)

    return run


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(WANTED_BITS)).astype(np.int64)


def _filtered(batches: Iterable[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    if wanted is None:
        yield from batches
        return
    bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).view(bool)
    for batch in batches:
        batch = batch.filter(pa.array(bits[_slots(batch.column("u").to_numpy())]))
        if batch.num_rows:
            yield batch


_BLOCK = 1 << 15


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(WANTED_BITS, bool)
    for b in batches:
        found[_slots(b.column("u").to_numpy())] = True
    blocks = np.packbits(found).reshape(-1, _BLOCK // 8)
    full = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_pydict({"block": pa.array(full, pa.int32()), "bits": pa.array([blocks[k].tobytes() for k in full], pa.binary())})


def _merged_bits(key: tuple, rows: pa.Table) -> pa.Table:
    every = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(every, axis=0).tobytes()], pa.binary())})


def _reread(rows: DataFrame, wanted: DataFrame, sets_of: SetsOf, of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """(node, n, tokens) of the wanted sets (node, u, h1, h2), of the row u of each.

    A filter of fixed size, 4 MB, leaves most other rows out before their texts are looked at; what passes it in vain is
    not in the join. Sets' rows move once, by the numbers that the join needs.
    """
    blocks = wanted.select("u").mapInArrow(_bits, "block int, bits binary").groupBy("block").applyInArrow(_merged_bits, "block int, bits binary").toArrow()
    whole = np.zeros((WANTED_BITS // _BLOCK, _BLOCK // 8), np.uint8)
    for k, b in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        whole[k] = np.frombuffer(b, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(whole.tobytes())
    found = rows.select("u", "text").mapInArrow(_made(sets_of, of, shared), "u long, n long, h1 long, h2 long, tokens array<long>")
    return found.join(wanted.select("node", "u", "h1", "h2"), ["u", "h1", "h2"]).dropDuplicates(["u", "h1", "h2"]).select("node", "n", "tokens")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, common, n, m): the overlap and sizes of each pair's sets."""
    one = full.select(F.col("node").alias("a"), F.col("n"), F.col("tokens").alias("_ta"))
    two = full.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("_tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("_ta", "_tb")).cast("long").alias("common"), "n", "m")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _rare_pairs(shared: DataFrame, ready: DataFrame) -> DataFrame:
    """(a, b) of sets that share rare tokens, as many as their frequent ones leave to be shared."""
    some = shared.where(F.col("held") < FREQUENT).select("token", "node").join(ready.where("rare >= need").select("node", "need"), "node")
    groups = some.groupBy("token").agg(F.collect_list(F.struct("node", "need")).alias("g")).where("size(g) > 1")  # at most FREQUENT - 1 sets
    pair = "x -> struct(least(x.l.node, x.r.node) as a, greatest(x.l.node, x.r.node) as b, greatest(x.l.need, x.r.need) as need)"
    every = F.expr(f"transform(flatten(transform(g, (l, i) -> transform(slice(g, i + 2, size(g)), r -> struct(l as l, r as r)))), {pair})")
    pairs = groups.select(F.explode(every).alias("p")).select("p.*").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"), F.max("need").alias("need")).where("s >= need").select("a", "b")


def _insides(full: DataFrame) -> DataFrame:
    """full with inside: how many of a set's tokens some other set has too. No overlap is larger.

    Each token is counted with the smallest node that has it, so that one exchange of tokens tells whose it is alone.
    """
    tokens = full.select("node", F.explode("tokens").alias("token"))
    alone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node")).where("held = 1").groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
    return full.select("node", "n", "tokens").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("inside"), "tokens")


def _connected(keys: DataFrame, full: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """(node, root) of the sets that links connect, among pairs and among the sets of each key.

    All sets of a key are compared with its head only, the set with the fewest tokens that no other has, as the most
    central one has. Those below one head that are not connected with it are then compared with the others there, if
    their sizes, their distances from the head, and what they can share of its tokens and of others leave room for a link.
    """
    linked = lambda v: v.where(like.holds(F.col("common"), F.col("n"), F.col("m"))).select("a", "b")
    sizes = stored(full.select("node", "n", "inside"), "shingle-sizes")
    some = keys.join(sizes, "node")
    heads = some.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("inside")).alias("lone"), "node")).alias("h"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    heads = stored(heads.select("key", F.col("h.node").alias("hnode")), "shingle-heads")
    led = stored(some.join(heads, "key").where("node <> hnode").select("node", "n", "inside", "hnode").distinct(), "shingle-led")
    first = led.select(*_ordered("node", "hnode"))
    inside = lambda at: sizes.select(F.col("node").alias(at), F.col("inside").alias(f"_{at}"))
    seen = stored(_verified(stored(pairs.join(inside("a"), "a").join(inside("b"), "b").select("a", "b").union(first).distinct(), "shingle-pairs"), full), "shingle-seen")
    roots = stored(components(linked(seen)), "shingle-roots")
    root = lambda at, to: roots.select(F.col("node").alias(at), F.col("root").alias(to))
    known = led.join(root("node", "_r"), "node", "left").join(root("hnode", "_h"), "hnode", "left")
    known = known.withColumn("root", F.coalesce("_r", "node")).withColumn("apart", F.col("root") != F.coalesce("_h", "hnode"))
    #: Distances from the head, a metric: sets that differ in them by more than a link allows are not linked.
    far = seen.select("a", "b", F.col("common").alias("with"), (1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("d"))
    known = known.withColumn("a", F.least("node", "hnode")).withColumn("b", F.greatest("node", "hnode")).join(far, ["a", "b"], "left")
    known = stored(known.select("hnode", "node", "n", "inside", "root", "apart", "with", "d"), "shingle-known")
    apart = known.where("apart").select("hnode", *[F.col(c).alias(f"x{c}") for c in ("node", "n", "inside", "root", "with", "d")])
    near = F.abs(F.col("d") - F.col("xd")) <= F.lit((100 - like.percent) / 100 + 1e-9)
    #: Two sets share no more of the head's tokens than either has, and no more others than either shares with any set.
    most = F.least("with", "xwith") + F.least(F.col("inside") - F.col("with"), F.col("xinside") - F.col("xwith"))
    again = known.join(apart, "hnode").where("root <> xroot and (node < xnode or not apart)")
    again = again.where(like.possible(F.col("n"), F.col("xn")) & near & like.holds(most, F.col("n"), F.col("xn")))
    again = stored(again.select(*_ordered("xnode", "node")).distinct(), "shingle-again")
    if again.isEmpty():
        return roots
    return stored(components(linked(seen).union(linked(_verified(again, full)))), "shingle-roots")


def classed(docs: DataFrame, sets_of: SetsOf, like: Likeness, partition: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows (doc_id, u, n, h1, h2) of all documents, u a hash of doc_id and text; found (h1, h2, root,
    least) of the sets that several documents have or that are linked, least the smallest doc_id of root's sets.

    partition: of a set's size, the partitions that its keys hold in; without it there is one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("u"), "doc_id", "text")
    made = stored(rows.mapInArrow(_made(sets_of, None), f"u long, doc_id {kind}, n long, h1 long, h2 long"), "shingle-rows")
    own = rows.select("u", "text").mapInArrow(_made(sets_of, lambda s: prefixes(like, s)), "u long, n long, h1 long, h2 long, tokens array<long>")
    sets = own.groupBy("h1", "h2").agg(F.min("u").alias("u"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    indexed = stored(sets.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    sets = stored(indexed.drop("tokens"), "shingle-nodes")
    postings = indexed.select("node", F.explode("tokens").alias("token"), "n")
    if partition is not None:
        postings = postings.withColumn("part", F.explode(partition(F.col("n")))).withColumn("token", F.xxhash64("part", "token"))
    postings = postings.select("token", "node")
    counts = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shingle-counts")
    shared = stored(postings.join(counts, "token"), "shingle-shared")
    forget(indexed, counts)
    often = F.col("held") >= FREQUENT
    per = shared.groupBy("node").agg(F.sum((~often).cast("long")).alias("rare"), F.sum(often.cast("long")).alias("frequent"))
    ready = per.join(sets.select("node", "n", "u", "h1", "h2"), "node").withColumn("least", like.least_shared(F.col("n")))
    ready = ready.withColumn("need", F.greatest(F.lit(1), F.col("least") - F.col("frequent"))).where("rare + frequent >= least")
    ready = stored(ready, "shingle-ready")
    pairs = stored(_rare_pairs(shared, ready), "shingle-rare")
    flagged = ready.where("frequent >= least")
    keys = _reread(rows, flagged, sets_of, lambda s: combinations(like, s)).select(F.explode("tokens").alias("key"), "node")
    keys = stored(keys, "shingle-keys")
    forget(shared)
    several = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    named = keys.join(several.select("key"), "key", "left_semi").select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    full = stored(_reread(rows, ready.join(named, "node", "left_semi"), sets_of, lambda s: s), "shingle-full")
    for _ in range(NARROWED):  # what goes has no link, so no pair is lost
        whole, full = full, stored(_insides(full).where(like.room(F.col("inside"), F.col("n"))), "shingle-insides")
        forget(whole)
    roots = _connected(keys, full, pairs, like)
    forget(full, ready, pairs, keys)
    copies = made.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    some = copies.join(sets.select("h1", "h2", "node"), ["h1", "h2"]).join(roots, "node", "left").where("copies > 1 or root is not null")
    some = stored(some.withColumn("root", F.coalesce("root", "node")), "shingle-some")
    least = some.groupBy("root").agg(F.min("rep").alias("least"))
    return made, stored(salted_join(some, least, "root", F.col("node")).select("h1", "h2", "root", "least"), "shingle-found")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Words are runs without white space, with A-Z lowered; a set is the distinct shingles, of a text with fewer words the
    whole sequence as one. Two documents link when 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have no set and no link. Equal texts, also repeated rows, are
    linked; a null doc_id is never the smallest unless all are null. Shingles of a pair are told apart by 64-bit hashes,
    sets by 128. An empty table gives an empty result; other columns are not read.
    """
    made, found = classed(docs, lambda texts: shingle_sets(texts, words), Likeness(words, percent))
    rows = made.join(found.select("h1", "h2", F.lit(1).alias("_hit"), "least"), ["h1", "h2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_hit") == 1, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, of equal ones that of the least hash of id and
    text; texts without words stay all. Null doc_ids are largest. An empty table gives an empty result.

    Only identical rows, which that hash does not tell apart, go through a further step; texts move once.
    """
    made, found = classed(docs, lambda texts: shingle_sets(texts, words), Likeness(words, percent))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "u")
    in_class = made.where("n > 0").join(found.select("h1", "h2", "root"), ["h1", "h2"])
    first = in_class.groupBy("root").agg(F.min(place).alias("first"))
    gone = salted_join(in_class, first, "root", F.col("u")).where(F.col("u") != F.col("first.u")).select("u")
    twice = made.where("n > 0").groupBy("u").count().where("count > 1").select("u", F.lit(True).alias("_twice"))
    gone = stored(gone.select("u", F.lit(False).alias("_twice")).distinct().union(twice.join(gone.select("u").distinct(), "u", "left_anti")), "shingle-gone")
    rows, at = numbered(docs)
    rows = rows.withColumn("u", F.xxhash64(at["doc_id"], at["text"])).join(gone, "u", "left")
    once = rows.where("_twice").dropDuplicates(["u"])
    return rows.where("_twice is null").unionByName(once).drop("u", "_twice").toDF(*docs.columns)
