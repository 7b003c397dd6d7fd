"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct five-word shingles. Each register keeps the minimum of exponentially
distributed hashes of the set's elements, truncated to a whole power of a base near 1: registers of a
union are the maxima of the parts' registers, and two registers agree about as often as the sets'
elements do. Documents with equal sets fall together first. Bands of registers give candidate buckets;
a pair's similarity is estimated by maximum likelihood from how many of its registers are greater, less
and equal, and pairs that may reach the threshold are verified on the full sets.

Pairs within a bucket are not listed: first each member is held against the bucket's smallest document.
Only where that leaves a bucket's members in several components are pairs from different components
listed, unless their estimate or their smallest hashes rule them out. A pair at the threshold shares no band, and so is missed,
with a chance of 5e-6.

Defined results: null, empty and wordless texts have no shingles and stand alone; one to four words are
one shingle; rows of one id are judged one by one, each by its own text; null ids sort after all others.
Sets, not ids, are what is linked: each distinct set gets a number of its own, called node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, discard, documents, keep, texts
from .components import components

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: SetSketch: registers grow by one for each factor BASE; RATE and LIMIT keep them in 16 bits.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose estimate is lower by more than five standard deviations than the threshold aren't verified.
LEAST_ESTIMATE = THRESHOLD / 100 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: As many registers at least are equal in pairs that such an estimate allows.
LEAST_EQUAL = int((LEAST_ESTIMATE - 0.04) * REGISTERS)
#: Smallest shingle hashes that pairs of different components are held against each other by.
BOTTOM = 512
#: Members of a bucket that are compared in one task; larger buckets are compared block by block.
BLOCK = 2000
#: Partners of a document that one task verifies.
PARTNERS = 1000
MEMO_WORDS = 400_000

_MIX = np.random.default_rng(0x5E75)
_XOR = _MIX.integers(1, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _MIX.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SKETCHED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("registers", pa.binary())])


class Shingler:
    """Sets of shingle hashes; remembers words' hashes."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mixed(out * _STEP + h[k : len(words) - size + 1 + k])
        return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set; merging sets takes the maxima of their registers."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    h = ((shingles >> np.uint64(32)) ^ shingles).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 256):  # blocks that stay in the cache
        x = (h[i : i + 256] ^ _XOR[:, None]) * _MUL[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, (x ^ (x >> np.uint32(12))).min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


_GRID = np.linspace(0, 1, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of rows of registers, given the sets' sizes."""
    greater, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    return likeliest(greater, less, a.shape[1] - greater - less, n_a.astype(float), n_b.astype(float))


def likeliest(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = _GRID * np.minimum(u / v, v / u)[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, fewer = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    fit = greater[:, None] * log(more) + less[:, None] * log(fewer) + equal[:, None] * log(1 - more - fewer)
    return grid[np.arange(len(u)), fit.argmax(1)]


def _ids(docs: DataFrame) -> DataFrame:
    """tie tells the texts of one id apart."""
    return documents(docs).withColumn("tie", F.xxhash64("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n (shingles), d1 and d2 (a hash of the set), registers, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler.shingles(t) for t in texts(b["text"])]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield batch(_SKETCHED, b["doc_id"], b["tie"], [len(s) for s in sets], both[:, 0], both[:, 1], [registers(s).tobytes() for s in sets])

    return arrow_map(_ids(docs), run, "doc_id long, tie long, n long, d1 long, d2 long, registers binary")


def bands(reps: DataFrame) -> DataFrame:
    """(bucket, band, node, n): a row for each band."""
    schema = pa.schema([("bucket", pa.int64()), ("band", pa.int8()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.frombuffer(b"".join(b["registers"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
            for k in range(ROWS):
                key = _mixed(key * _STEP + r[:, :, k])
            ids, n = (np.repeat(b[c].to_numpy(zero_copy_only=False), BANDS) for c in ("node", "n"))
            yield batch(schema, key.ravel().astype(np.int64), np.tile(np.arange(BANDS, dtype=np.int8), len(r)), ids, n)

    return arrow_map(reps.select("node", "n", "registers"), run, "bucket long, band tinyint, node long, n long")


def _near(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {THRESHOLD} * greatest({a}, {b})"


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose registers allow the threshold."""
    r = reps.select("node", "n", "registers")
    both = pairs.join(r.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("registers").alias("ru")), "u").join(r.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("registers").alias("rv")), "v")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, z = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ru", "rv"))
                yield b.select(["u", "v"]).filter(pa.array(estimate(a, z, b["nu"].to_numpy(), b["nv"].to_numpy()) >= LEAST_ESTIMATE)).cast(schema)

    return arrow_map(both.select("u", "v", "nu", "nv", "ru", "rv"), run, "u long, v long")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose full sets reach the threshold. held: node and text.

    A document's partners are dealt over as many tasks as their number asks for, each of which gets its text once and then theirs, one by one.
    """
    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    salted = pairs.join(salts, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts"))).drop("salts")
    members = salted.join(held.select(F.col("node").alias("v"), "text"), "v").select("u", "salt", "v", "text", F.lit(1).alias("turn"))
    heads = salted.select("u", "salt").distinct().join(held.select(F.col("node").alias("u"), "text"), "u").select("u", "salt", F.col("u").alias("v"), "text", F.lit(0).alias("turn"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head, own = Shingler(), None, np.zeros(0, np.uint64)
        for b in batches:
            us, vs = [], []
            for u, v, text, turn in zip(*(b[c].to_pylist() for c in ("u", "v", "text", "turn")), strict=True):
                s = shingler.shingles(text or "")
                if not turn:
                    head, own = u, s
                    continue
                if head != u:
                    raise ValueError(f"no text of document {u}")
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * common >= THRESHOLD * (len(own) + len(s) - common):
                    us.append(u)
                    vs.append(v)
            yield batch(schema, us, vs)

    dealt = heads.unionByName(members).repartition("u", "salt").sortWithinPartitions("u", "salt", "turn")
    return arrow_map(dealt, run, "u long, v long")


def star_pairs(banded: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest node, if their sizes allow the threshold."""
    heads = banded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("members")).filter("members > 1").select("bucket", F.col("head.node").alias("u"), F.col("head.n").alias("nu"))
    return banded.join(heads, "bucket").filter("node > u").filter(_near("n", "nu")).select("u", F.col("node").alias("v")).distinct()


def smallest(held: DataFrame, ids: DataFrame) -> DataFrame:
    """node and the smallest BOTTOM shingle hashes, in order: all of them for most documents."""
    schema = pa.schema([("node", pa.int64()), ("bottom", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            yield batch(schema, b["node"], [shingler.shingles(t)[:BOTTOM].tobytes() for t in texts(b["text"])])

    return arrow_map(held.join(ids, "node", "left_semi").select("node", "text"), run, "node long, bottom binary")


def bottom_similarity(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, float]:
    """The similarity that the smallest hashes say, and the least that a pair at the threshold shows: exact for small sets."""
    common = np.intersect1d(a, b, assume_unique=True)
    if n_a <= BOTTOM and n_b <= BOTTOM:
        return len(common) / max(1, n_a + n_b - len(common)), THRESHOLD / 100 - 1e-12
    union = np.union1d(a, b)[:BOTTOM]
    return np.searchsorted(common, union[-1], "right") / len(union), THRESHOLD / 100 - 5 * (0.75 * 0.25 / len(union)) ** 0.5


def cross_pairs(banded: DataFrame, reps: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components that neither registers nor smallest hashes rule out. found: (node, component).

    A pair is looked at in the first band that it shares. Sets of up to BOTTOM shingles are compared exactly,
    so of a group that hangs together only as many pairs are listed as tie it up.
    """
    of = banded.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low < high").select("bucket", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    members = keep(of.join(mixed, "bucket"), "near-mixed")
    sets = smallest(held, members.select("node").distinct())
    inside = members.join(reps.select("node", "registers").join(sets, "node"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = inside.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for b in _and_end(batches):
            t = carry if b is None else pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            bucket, low, high = (t[c].to_numpy() for c in ("bucket", "low", "high"))
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            begin = [0, *new.tolist()]
            ends = [*begin[1:], t.num_rows]
            done = len(begin) if b is None else len(begin) - 1  # the last bucket may go on
            carry = None if b is None else t.slice(begin[-1])
            if done:
                band, ids, n, part, own = (t[c].to_numpy() for c in ("band", "node", "n", "component", "own"))
                bits, sets = t["registers"].to_pylist(), t["bottom"].to_pylist()
                us, vs = [], []
                for x, y in zip(begin[:done], ends[:done], strict=True):
                    if y - x > 1:
                        found = _ties(ids[x:y], n[x:y], part[x:y].copy(), own[x:y], bits[x:y], sets[x:y], int(band[x]), low[x] == high[x])
                        us += found[0]
                        vs += found[1]
                yield batch(schema, us, vs)

    keys = ["bucket", "low", "high"]
    parts = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "node").select(*keys, "band", "node", "n", "component", "own", "registers", "bottom")
    return arrow_map(sorted_, run, "u long, v long").distinct()


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _ties(ids, n, part, own, bits, sets, band: int, one_block: bool) -> tuple[list[int], list[int]]:
    """Pairs of a bucket, ordered by id, that may link different components. part: components; changes as links are certain."""
    r = np.frombuffer(b"".join(bits), np.uint16).reshape(-1, REGISTERS)
    bands_of = r.view(np.uint64)  # a band's four registers as one number
    us: list[int] = []
    vs: list[int] = []
    for i in range(len(ids)):
        j = np.arange(i + 1, len(ids))
        j = j[(part[j] != part[i]) & (100 * np.minimum(n[j], n[i]) >= THRESHOLD * np.maximum(n[j], n[i])) & (one_block | (own[j] != own[i]))]
        if band and len(j):
            j = j[~(bands_of[j, :band] == bands_of[i, :band]).any(1)]
        if len(j):
            j = j[(r[j] == r[i]).sum(1) >= LEAST_EQUAL]
        if len(j):
            j = j[estimate(np.broadcast_to(r[i], (len(j), REGISTERS)), r[j], np.full(len(j), n[i]), n[j]) >= LEAST_ESTIMATE]
        for k in j:
            if part[k] == part[i]:
                continue
            like, least = bottom_similarity(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[k], np.uint64), n[i], n[k])
            if like >= least:
                us.append(int(ids[i]))
                vs.append(int(ids[k]))
                if max(n[i], n[k]) <= BOTTOM:  # a link for certain
                    part[part == part[k]] = part[i]
    return us, vs


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n_shingles, component_id (smallest id reachable over links) and kept, for every row."""
    sketched = keep(sketches(docs), "near-sketches")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("least")
    sets = sketched.filter("n > 0").groupBy("d1", "d2").agg(least, F.first("n").alias("n"), F.first("registers").alias("registers"))
    reps = keep(sets.select("d1", "d2", "least.doc_id", "least.tie", "n", "registers", F.monotonically_increasing_id().alias("node")), "near-reps")
    banded = keep(bands(reps), "near-bands")
    tested = keep(estimated(star_pairs(banded), reps), "near-pairs")
    involved = banded.join(banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket"), "bucket", "left_semi").select("node").distinct()
    of = reps.select("node", F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).join(involved, "node", "left_semi")
    held = keep(_ids(docs).join(of.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("tie").eqNullSafe(F.col("__tie"))).select("node", "text"), "near-texts")
    links = keep(verified(tested, held), "near-links")
    found = keep(components(links), "near-components")
    more = keep(cross_pairs(banded, reps, held, found).join(tested, ["u", "v"], "left_anti"), "near-cross")
    if not more.isEmpty():
        links = links.unionByName(keep(verified(more, held), "near-links"))
        found = keep(components(links), "near-components")
    discard(banded, tested, held, more)
    least_ids = found.join(reps.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(least_ids, "component").select("node", "component_id", F.lit(True).alias("linked"))
    classes = reps.select("node", "d1", "d2", "doc_id").join(linked, "node", "left").select("d1", "d2", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = sketched.select("doc_id", "tie", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), alone.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, for every row."""
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, whole, of the document with the smallest id of each group; documents without words all stay, and so do rows that are alike.

    Of an id with several texts, only the rows whose text is kept stay.
    """
    stay = _judged(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"))
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("__tie")), "left_semi")
