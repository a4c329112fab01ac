"""N-gram Jaccard join: a MinHash LSH forest proposes groups, exact set comparison confirms links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import WORD_BYTES, discard, pieces, stash, texts_of
from tessera.llm.components import components


@dataclass(frozen=True)
class Settings:
    """tries x depth hashes a text (depth at most 7, tries at most 255): a signature in a trie is one long, the trie's number and a
    byte for each level. Prefixes are shortened from depth down while the pairs found show that more than 1 - recall of them are
    still missed, but not below the level at which a pair at the threshold is met with probability `recall`. Groups are compared
    in squares of two sides, each of about side_bytes of shingles and side texts."""

    n: int = 5
    threshold: float = 0.8
    tries: int = 24
    depth: int = 7
    recall: float = 0.999
    side: int = 512
    side_bytes: int = 1 << 20
    seed: int = 11
    block_bytes: int = 1 << 19


ODD = np.uint64(0x9E3779B97F4A7C15)
LEVELS = 7


def least_depth(s: Settings) -> int:
    """The longest prefix at which a pair with Jaccard similarity at the threshold shares one in some trie with probability
    `recall`. Shorter ones can't be needed."""
    d = s.depth
    while d > 1 and 1 - (1 - s.threshold**d) ** s.tries < s.recall:
        d -= 1
    return d


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Hashes (64 bits) of the word n-grams of texts. A word is hashed by a polynomial over its bytes, an n-gram by one over
    its words; fewer than n words, but not none, are one n-gram."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

    def words(self, data: bytes) -> Iterator[np.ndarray]:
        """Word hashes of lower-cased bytes in which spaces part words, block by block. A word is the sum of its bytes' hashes by
        place, so one that a block cuts is carried on as the sum so far and its length."""
        total, length = np.uint64(0), 0
        for at in range(0, len(data), self.s.block_bytes):
            b = np.frombuffer(data, np.uint8, min(self.s.block_bytes, len(data) - at), at)
            inside = b != 32
            edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
            starts, ends = edge[::2], edge[1::2]
            first = np.zeros(len(b), np.int64)
            first[starts] = starts
            place = (np.arange(len(b)) - np.maximum.accumulate(first)).astype(np.uint64)
            goes_on = length > 0 and inside[0]
            if goes_on:
                place[: ends[0]] += np.uint64(length)
            x = _mixed(self.of_byte[b] + place * ODD)
            x[~inside] = 0
            sums = np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.uint64)
            sizes = (ends - starts).astype(np.uint64)
            if goes_on:
                sums[:1] += total
                sizes[:1] += np.uint64(length)
            elif length:
                sums, sizes = np.append(total, sums), np.append(np.uint64(length), sizes)
            total, length = np.uint64(0), 0
            if inside[-1]:
                total, length, sums, sizes = sums[-1], int(sizes[-1]), sums[:-1], sizes[:-1]
            yield _mixed(sums + sizes)
        if length:
            yield _mixed(np.array([total], np.uint64) + np.uint64(length))

    def of(self, text: str | None) -> np.ndarray:
        """The set of a text's n-gram hashes, sorted."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        parts, left = [], np.zeros(0, np.uint64)
        for own in self.words(data):
            w = np.concatenate((left, own))
            if len(w) >= self.s.n:
                k = len(w) - self.s.n + 1
                h = np.zeros(k, np.uint64)
                for i in range(self.s.n):
                    h = h * ODD + w[i : i + k]
                parts.append(np.unique(_mixed(h)))
                left = w[k:]
            else:
                left = w
        if not parts and len(left):
            h = np.zeros(1, np.uint64)
            for i in range(len(left)):
                h = h * ODD + left[i : i + 1]
            parts.append(_mixed(h))
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_name(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Forest:
    """The signatures of a set of shingles in all tries."""

    def __init__(self, s: Settings) -> None:
        if not (1 <= s.depth <= LEVELS and 1 <= s.tries <= 255):
            raise ValueError("a signature is a byte for the trie and at most seven for its levels")
        rng = np.random.default_rng(s.seed + 1)
        self.depth, self.tries = s.depth, s.tries
        n = s.tries * s.depth
        self.mul = (rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(s.tries, s.depth)
        self.xor = rng.integers(1, 1 << 63, n, dtype=np.uint64).reshape(s.tries, s.depth)

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """One long a trie: its number in the highest byte, then a byte of the smallest hash of each level, the first level first."""
        out = np.arange(self.tries, dtype=np.uint64)
        # one hash of all tries at a time: memory is tries x shingles
        for j in range(self.depth):
            low = np.full(self.tries, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(shingles), 4096):
                part = shingles[at : at + 4096]
                np.minimum(low, (((part ^ (part >> np.uint64(31)))[None, :] ^ self.xor[:, j : j + 1]) * self.mul[:, j : j + 1]).min(axis=1), out=low)
            out = (out << np.uint64(8)) | (_mixed(low * ODD) >> np.uint64(56))
        return (out << np.uint64(8 * (LEVELS - self.depth))).view(np.int64)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, mark (a checksum of the text), name of the set of shingles (null: no words), their number, signatures in the tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, forest = Shingles(s), Forest(s)
        for batch in pieces(batches):
            name, n, keys = [], [], []
            for text in texts_of(batch):
                own = shingles.of(text)
                n.append(len(own))
                name.append(set_name(own) if len(own) else None)
                keys.append(forest.signatures(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(name, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "name", "n", "keys"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return own.mapInArrow(run, "doc_id long, mark long, name binary, n long, keys array<long>")


def trie_links(vertices: DataFrame, s: Settings) -> DataFrame:
    """u, v, depth: each vertex (v, keys) linked, in each trie, to the head of the run of its longest matching prefix.

    The signatures of all tries are sorted together. In that order whoever shares a prefix stands side by side, at every length
    of prefix at once; so one pass that compares each signature with the one before tells the longest prefix that it shares
    with anybody before it, and it is linked to the first of those. A link is kept if that is least_depth levels or more. Runs
    that go on in the next partition are joined through the last and first rows of the partitions: two rows a partition.
    """
    floor, deep = least_depth(s), s.depth
    shift = {d: 8 * (LEVELS - d) for d in range(floor, deep + 1)}
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("depth", pa.int32()), ("edge", pa.int32())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads = None, {}
        for batch in batches:
            k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([v[0]], [k[0]], [0], [1]), schema, strict=True)], schema=schema)
                last, heads = (~k[0], v[0]), dict.fromkeys(shift, v[0])
            differ = (k ^ np.concatenate(([last[0]], k[:-1]))).view(np.uint64)
            done = np.zeros(len(k), bool)
            for d in range(deep, floor - 1, -1):
                same = (differ >> np.uint64(shift[d])) == 0
                begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(k))))
                head = np.where(begin < 0, heads[d], v[begin])
                heads[d] = head[-1]
                new = same & ~done & (head != v)
                done |= same
                if new.any():
                    m = int(new.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(v[new]), pa.array(head[new]), pa.array(np.full(m, d, np.int32)), pa.array(np.zeros(m, np.int32))], schema=schema)
            last = (k[-1], v[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([last[1]], [last[0]], [0], [2]), schema, strict=True)], schema=schema)

    partitions = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vertices.select(F.explode("keys").alias("key"), "v").repartitionByRange(partitions, "key", "v").sortWithinPartitions("key", "v")
    found = stash(rows.mapInArrow(walk, "u long, v long, depth int, edge int"), "trie-links")
    before = W.orderBy("v", "u", "edge")  # two rows a partition
    edges = found.where("edge > 0").select("u", "v", "edge", F.lag("u").over(before).alias("w"), F.lag("v").over(before).alias("x"))
    matched = F.coalesce(*(F.when(F.shiftrightunsigned(F.col("v").bitwiseXOR(F.col("x")), n) == 0, d) for d, n in sorted(shift.items(), reverse=True)))
    across = edges.where("edge = 1").select("u", F.col("w").alias("v"), matched.alias("depth")).where("depth is not null and u <> v")
    out = found.where("edge = 0").select("u", "v", "depth").unionByName(across)
    out._stashed_at = found._stashed_at
    return out


def shortened(links: DataFrame, s: Settings) -> int:
    """The level to which prefixes are shortened, from the links of all tries.

    At each level, from the deepest up, the pairs found in one trie only and in two give Chao's estimate of the pairs that no trie
    has found. The first level that misses a share of 1 - recall or less will do; if none does, least_depth() is safe for any
    pair at the threshold. The estimate counts pairs that aren't alike too, which can only make prefixes shorter.
    """
    floor = least_depth(s)
    if floor == s.depth:
        return floor
    levels = range(floor + 1, s.depth + 1)
    pairs = links.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(*(F.count_if(F.col("depth") >= d).alias(f"c{d}") for d in levels))
    row = pairs.agg(*(F.count_if(F.col(f"c{d}") >= 1 if k == 0 else F.col(f"c{d}") == k).alias(f"n{d}_{k}") for d in levels for k in range(3))).first()
    for d in reversed(levels):
        found, once, twice = (row[f"n{d}_{k}"] for k in range(3))
        missed = (s.tries - 1) / s.tries * once * (once - 1) / (2 * (twice + 1))
        if found and missed <= (1 - s.recall) * (found + missed):
            return d
    return floor


def _tiles(sizes: np.ndarray, begin: int, end: int, step: int, most: int = 1 << 16) -> list[tuple[int, int]]:
    """begin to end in spans of at most step sets and, unless a set is larger, `most` shingles."""
    spans, at, total = [], begin, 0
    for k in range(begin, end):
        if k > at and (k - at == step or total + sizes[k] > most):
            spans.append((at, k))
            at, total = k, 0
        total += int(sizes[k])
    return [*spans, (at, end)] if end > begin else spans


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sets with Jaccard similarity of at least threshold, i < j if right is None.

    Two tiles of at most `step` sets are compared at a time, so that what is held besides the sets is bounded by a tile. Shingles
    that only one set of the tiles has don't matter for intersections, and those that all have count the same for each pair:
    both are taken out. What is left is compared as a product of 0/1 matrices, 2048 shingles at a time.
    """
    both = left if right is None else left + right
    sizes = np.array([len(x) for x in both], np.int64)
    nl = len(left)
    spans = _tiles(sizes, 0, nl, step)
    others = spans if right is None else _tiles(sizes, nl, len(both), step)
    for a in spans:
        for b in others:
            if right is None and b[0] < a[0]:
                continue
            members = list(range(*a)) + ([] if a == b else list(range(*b)))
            owner = np.repeat(np.arange(len(members), dtype=np.int32), sizes[members])
            values = np.concatenate([both[k] for k in members])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            count = np.diff(np.append(first, len(values)))
            everywhere = int((count == len(members)).sum())
            useful = (count > 1) & (count < len(members))
            column = np.repeat((np.cumsum(useful) - 1).astype(np.int32), count)
            take = np.repeat(useful, count)
            owner, column = owner[take], column[take]  # in order of columns
            na, width = a[1] - a[0], int(useful.sum())
            common = np.full((na, b[1] - b[0]), everywhere, np.float32)
            for low in range(0, width, 2048):
                high = min(width, low + 2048)
                i, j = np.searchsorted(column, (low, high))
                m = np.zeros((len(members), high - low), np.float32)
                m[owner[i:j], column[i:j] - low] = 1
                common += m[:na] @ (m if a == b else m[na:]).T
            common = np.rint(common).astype(np.int64)
            total = sizes[a[0] : a[1], None] + sizes[None, b[0] : b[1]] - common
            i, j = np.nonzero(common >= np.ceil(threshold * total - 1e-9))
            i, j = i + a[0], j + b[0]
            if right is None:
                keep = i < j
                i, j = i[keep], j[keep]
            yield i, j - (0 if right is None else nl)


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the n sets under the pairs, and each one's links, counted by the weights of the other side."""
    parent, links = list(range(n)), np.zeros(n, np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        j = j + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        label = np.array([root(x) for x in range(n)])
        for x, y in set(zip(label[i].tolist(), label[j].tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(n)], np.int64), links


def join_classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row a document: doc_id, class_id, n_links.

    Texts are linked if the Jaccard similarity of their sets of word 5-grams is 0.8 or more. n_links counts the other documents
    linked to this one, copies included; class_id is the smallest doc_id that chains of links reach. A text without words
    (null, empty) has no links and is a class of its own. Rows with equal doc_id but different texts are kept apart; null ids
    never lend a class its name unless all are null. Repeated rows are rows of their own. An empty table has an empty result. A
    text of any length is read whole; its set is held by one task. Other columns, whatever their names, are left behind.

    1. Each text becomes the name of its shingle set and its signatures, in a map. Equal sets are one vertex from here on.
    2. trie_links() matches prefixes in all tries: a link a signature at most, never pairs within a group. shortened() says how
       long a prefix must match.
    3. Connected components of these links are the groups to compare; only their texts are read again.
    4. A group is compared exactly, in squares of two sides of bounded bytes and texts; a square returns counts of links and a
       spanning forest, never the pairs.
    5. Components of the confirmed links are the classes.
    """
    sig = stash(signatures(docs, s), "signatures")
    vertices = sig.where("name is not null").groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("keys").alias("keys"),
    )
    vertices = stash(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    links = trie_links(vertices, s)
    stars = links.where(F.col("depth") >= shortened(links, s)).select("u", "v").distinct()
    near = components(stars)
    discard(links)
    members = near.select(F.col("u").alias("v"), F.col("v").alias("g")).unionByName(near.select("v", F.col("v").alias("g")).distinct())
    members = stash(members.join(vertices.drop("keys", "name"), "v"), "members")
    discard(near)
    groups = members.groupBy("g").agg(F.ceil(F.greatest(F.sum("n") * 8 / s.side_bytes, F.count("*") / s.side)).cast("int").alias("sides"))
    wanted = members.join(groups, "g").withColumn("side", F.pmod(F.xxhash64("v"), F.col("sides").cast("long")).cast("int"))
    confirmed = stash(_compare(docs, wanted, s), "confirmed")
    classes = components(confirmed.where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v")))
    n_links = confirmed.groupBy("v").agg(F.sum("links").alias("links"))
    known = members.select("v", "rep").join(n_links, "v", "left").join(classes.select(F.col("u").alias("v"), F.col("v").alias("c")), "v", "left")
    known = known.withColumn("c", F.coalesce("c", "v"))
    names = known.groupBy("c").agg(F.min("rep").alias("class_id"))
    known = known.join(names, "c").select("v", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    found = vertices.select("name", "v", "rep", "copies").join(known, "v", "left").select(
        "name", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    found = stash(found, "classes")  # a plain table, so that adaptive execution can split a large group of copies below
    out = stash(
        sig.select("doc_id", "name").join(found, "name", "left").select(
            "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        ),
        "neardup",
    )
    for x in (sig, vertices, members, confirmed, classes, found):
        discard(x)
    return out


def _compare(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """v, root, links of each vertex in each square that it takes part in."""
    # a merge join at every size: what is wanted grows with the corpus and is never broadcast. The checksum of the text keeps rows
    # without an id, or of the same id, from meeting each other's vertices.
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__mark"), "text")
    texts = texts.join(wanted.hint("merge"), F.col("__id").eqNullSafe(F.col("rep")) & (F.col("__mark") == F.col("mark")))
    sets = pa.schema([("v", pa.int64()), ("g", pa.int64()), ("sides", pa.int32()), ("side", pa.int32()), ("copies", pa.int64()), ("set", pa.binary())])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, done = Shingles(s), None
        for batch in pieces(batches, 64):
            take, found = [], []
            for k, (v, text) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch), strict=True)):
                if v != done:  # repeated rows of a document follow one another
                    done = v
                    take.append(k)
                    found.append(shingles.of(text).tobytes())
            rows = batch.select(sets.names[:-1]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], schema=sets)

    own = texts.select("v", "g", "sides", "side", "copies", "text").mapInArrow(shingle, "v long, g long, sides int, side int, copies long, set binary")
    dealt = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("g", F.least("side", "k").alias("a"), F.greatest("side", "k").alias("b"), "v", "side", "copies", "set")
    result = pa.schema([("v", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        v, side, copies = (table.column(c).to_numpy() for c in ("v", "side", "copies"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        seen = np.unique(v, return_index=True)[1]  # a vertex counts once if rows of its document came from several tasks
        order = seen[np.lexsort((v[seen], side[seen]))]
        data = []
        for chunk in table.column("set").chunks:
            at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            values = chunk.buffers()[2]
            data += [np.frombuffer(values, np.uint64, (y - x) // 8, x) for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
        data = [data[k] for k in order]
        n_left = int((side[order] == a).sum()) if a != b else len(order)
        left, right = data[:n_left], data[n_left:]
        if not left or a != b and not right:
            return result.empty_table()
        pairs = links_within(left, right if a != b else None, s.threshold)
        roots, links = _roots(len(order), pairs, copies[order], n_left if a != b else 0)
        return pa.table([pa.array(v[order]), pa.array(v[order][roots]), pa.array(links)], schema=result)

    return dealt.groupBy("g", "a", "b").applyInArrow(compare, "v long, root long, links long")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs, all columns, with the document of the smallest id of each class; rows without an id stay."""
    gone = join_classes(docs, s).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
