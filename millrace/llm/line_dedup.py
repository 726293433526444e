"""Fuzzy line deduplication over a whole corpus.

1. Every line that isn't blank (white space collapsed, lower case) gets a 64-bit key
   and a MinHash signature over its character shingles, by one permutation hashing
   with densification. Equal lines are one key from here on. A line shorter than a
   shingle is its own only shingle, so it is similar to equal lines alone: it needs
   the key and no signature.
2. Bands of the signature are shuffled; a bucket with two or more distinct keys
   holds candidates. Rows of a very common band aren't brought together for that. With 12 bands of 4 values a pair at the threshold 0.8 meets
   with probability 0.998, closer pairs still more surely.
3. Exact Jaccard of the shingle sets (64-bit hashes of the shingles) confirms pairs:
   first each member of a bucket against its smallest, then, only in buckets of three
   or more where that did not join all, the members that are not joined yet, in blocks
   of bounded size. Bitmaps of the shingles rule out most pairs that aren't similar
   before their sets are made, and no others. Pairs that a
   component joins already are not looked at, so a bucket of thousands of copies of
   one line costs one comparison for each, and no bucket emits all its pairs.
4. Distributed union-find gives components; of each component's occurrences the
   first by (doc_id, line number) stays and the others are taken out.

The texts of candidate lines are gathered by a second pass over the documents,
behind a bitmap of the candidates' keys whose size is fixed (`BITMAP_BITS`); where
it fills up it lets more lines through, and a join sorts those out.

Defined results: blank lines stay, and so do lines shorter than `min_chars` where a
caller asks for more than 1; a null text stays null; rows that repeat both doc_id and text are one document, and each
keeps the same lines; a null doc_id comes first in the order; equal positions can
only arise between rows of one doc_id and then the smaller hash of the row comes
first; extra columns are passed through; an empty table gives an empty result. Two
different lines share a key with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh_name
from millrace.llm.components import connected_components

SHINGLE = 8  # a power of two
MIN_CHARS = 1
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
BITMAP_BITS = 1 << 24
BLOCK = 512
BITS = 2048
HOT_SHARE, HOT_SAMPLE, HOT_LEAST = 1000, 64, 64
_SEEN = 250_000
_BATCH_CHARS = 1 << 19
_CHUNK_CHARS = 1 << 17  # arrays of this many numbers stay in a core's cache
_EMPTY = np.uint32(0xFFFFFFFF)


def normalized(line: str) -> str:
    """White space collapsed, lower case."""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line.lower()  # no white space but single spaces
    return " ".join(line.split()).lower()


def line_key(line: str) -> int:
    k = xxhash.xxh3_64_intdigest(line)
    return k - (1 << 64) if k >> 63 else k


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(2)
def _sources(k: int) -> np.ndarray:
    """Where bin c looks at its attempt t: anywhere at first, in turn at last."""
    t, c = np.arange(4 * k)[:, None], np.arange(k)[None, :]
    return np.where(t < 3 * k, (_mix((c * 1000 + t).astype(np.uint64)) % np.uint64(k)).astype(np.int64), (c + t) % k)


def _chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of a bounded number and of bounded length, but for a line that is longer by itself."""
    lo = chars = 0
    for i, line in enumerate(lines):
        chars += len(line)
        if chars >= _CHUNK_CHARS or i - lo >= 1023:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(lines):
        yield lo, len(lines)


def band_hashes(lines: list[str]) -> np.ndarray:
    """Hashes of the bands of each line's signature."""
    return np.concatenate([_band_hashes(lines[lo:hi]) for lo, hi in _chunks(lines)])


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines' shingles one after the other, and the line that each is of."""
    n = len(lines)
    lines = [x.ljust(SHINGLE, "\0") for x in lines]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    rolled, step, factor = codes, 1, 0x9E3779B97F4A7C15
    while 2 * step <= SHINGLE:  # hashes of runs twice as long from those of neighbouring runs
        rolled = rolled[:-step] * np.uint64(factor) + rolled[step:]
        step, factor = 2 * step, factor * factor % (1 << 64)
    if rest := SHINGLE - step:  # two runs that overlap
        rolled = rolled[:-rest] * np.uint64(factor) + rolled[rest:]
    ends = np.cumsum(size)
    whole = np.ones(len(codes), dtype=bool)  # no run that goes on into the next line
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    return _mix(rolled[whole[: len(rolled)]]), np.repeat(np.arange(n), size - (SHINGLE - 1))


def _band_hashes(lines: list[str]) -> np.ndarray:
    k = BANDS * ROWS
    n = len(lines)
    h, line = _shingle_hashes(lines)
    slot = h >> np.uint64(32)
    slot *= np.uint64(k)
    slot >>= np.uint64(32)
    slot = slot.view(np.int64)
    slot += line * k
    flat = np.full(n * k, _EMPTY, dtype=np.uint32)
    np.minimum.at(flat, slot, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    first = flat.reshape(n, k)
    full = first.copy()
    rows, cols = np.nonzero(first == _EMPTY)
    for t in range(1, 4 * k):  # an empty bin takes the value of the first full one of its own sequence
        if not len(rows):
            break
        source = _sources(k)[t, cols]
        found = first[rows, source]
        full[rows, cols] = found
        still = found == _EMPTY
        rows, cols = rows[still], cols[still]
    parts = full.reshape(n, BANDS, ROWS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
    for r in range(ROWS):
        x = _mix(x + parts[:, :, r])
    return x.view(np.int64)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each line's shingles."""
    out = []
    for lo, hi in _chunks(lines):
        h, at = _shingle_hashes(lines[lo:hi])
        ends = np.flatnonzero(np.diff(at, append=hi - lo)) + 1
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            x = np.sort(h[begin:end])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have a Jaccard of `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) >= least


def bitmaps(lines: list[str]) -> list[int]:
    """For each line a number with a bit set for every value of its shingles' hashes modulo BITS."""
    out: list[int] = []
    for lo, hi in _chunks(lines):
        h, at = _shingle_hashes(lines[lo:hi])
        bits = np.zeros((hi - lo, BITS), dtype=np.uint8)
        bits.reshape(-1)[at * BITS + (h & np.uint64(BITS - 1)).view(np.int64)] = 1
        packed = np.packbits(bits, axis=1).tobytes()
        out += [int.from_bytes(packed[k : k + BITS // 8]) for k in range(0, len(packed), BITS // 8)]
    return out


def _may_be_similar(x: int, y: int, m: int, n: int, least: float) -> bool:
    """Whether lines with bitmaps x and y and m and n shingles can be: bits of one alone are shingles of one alone."""
    common = min(m, n)
    return common >= least * (common + (x ^ y).bit_count())


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (row_key, doc_id, line_no, key, bands); bands only where a task meets the line first, if it has a shingle's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def make(rows: list, fresh: list[str], where: list[int]) -> pa.RecordBatch:
            has = np.zeros(len(rows), dtype=bool)
            has[where] = True
            ends = np.concatenate([[0], np.cumsum(has) * BANDS]).astype(np.int32)
            values = pa.array(band_hashes(fresh).reshape(-1) if fresh else [], pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~has))
            r, d, n, k = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int64()), bands], ["row_key", "doc_id", "line_no", "key", "bands"])

        rows, fresh, where, chars = [], [], [], 0
        for b in batches:
            for row_key, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) < min_chars or len(norm := normalized(line)) < min_chars:
                        continue
                    key = line_key(norm)
                    if key not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        if len(norm) >= SHINGLE:
                            where.append(len(rows))
                            fresh.append(norm)
                            chars += len(norm)
                    rows.append((row_key, doc_id, no, key))
                    if chars >= _BATCH_CHARS or len(rows) >= 20_000:
                        yield make(rows, fresh, where)
                        rows, fresh, where, chars = [], [], [], 0
        if rows:
            yield make(rows, fresh, where)

    return docs.mapInArrow(run, "row_key long, doc_id long, line_no int, key long, bands array<long>")


def _texts(docs: DataFrame, members: DataFrame, min_chars: int) -> DataFrame:
    """Rows (key, line) for the distinct keys of `members`."""
    spark = docs.sparkSession
    bit = F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = members.select("key").distinct().groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {63}L) as int))")).alias("bits"))
    got = words.toPandas()  # BITMAP_BITS / 64 rows at most
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    bitmap[got["w"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little")
        seen: set[int] = set()
        for b in batches:
            keys, lines = [], []
            for text in b.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < min_chars or len(norm := normalized(line)) < min_chars:
                        continue
                    key = line_key(norm)
                    if bits[key & (BITMAP_BITS - 1)] and key not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        keys.append(key)
                        lines.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.string())], ["key", "line"])

    found = docs.select("text").mapInArrow(run, "key long, line string")
    return found.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those rows (a, b) of `pairs` whose lines are similar."""

    def checked(xs: list[str], ys: list[str]) -> list[bool]:
        own = [*dict.fromkeys(ys)]  # rows come sorted by the smaller line's key
        own_bits = dict(zip(own, bitmaps(own)))
        ok = [_may_be_similar(x_bits, own_bits[y], len(x) - SHINGLE + 1, len(y) - SHINGLE + 1, least) for x, x_bits, y in zip(xs, bitmaps(xs), ys)]
        left = [i for i, maybe in enumerate(ok) if maybe]
        needed = [*dict.fromkeys(ys[i] for i in left)]
        sets = dict(zip(needed, shingle_sets(needed)))
        for i, x in zip(left, shingle_sets([xs[i] for i in left])):
            ok[i] = similar(x, sets[ys[i]], least)
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [maybe for lo, hi in _chunks(xs) for maybe in checked(xs[lo:hi], ys[lo:hi])]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("key").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("line").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified_blocks(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between lines of different `root` in the buckets of `members` (band, key, least, root, n).

    A bucket of n lines is dealt into blocks by the lines' hashes, and every pair of
    blocks is one piece of work of bounded size; a piece returns no more links than
    it has lines. Buckets with the same smallest member, mostly the same lines met in
    other bands, go to one task and a pair is looked at once. That no line of another
    root is similar to the bucket's smallest is known already.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("band", "key", "least", "root", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("least", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "key", "root").join(texts, "key")
    order = ["least", "lo", "hi", "band", "key"]
    work = dealt.repartition("least", "lo", "hi").sortWithinPartitions(*order).select(*order, "root", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = band_now = None
        known: dict[int, tuple[str, int]] = {}  # lines of one piece of work, with their bitmaps
        sets: dict[int, np.ndarray] = {}  # of those that needed them
        apart: set[tuple[int, int]] = set()
        parent: dict[int, int] = {}
        group: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def alike(a: int, b: int) -> bool:
            (x, x_bits), (y, y_bits) = known[a], known[b]
            if not _may_be_similar(x_bits, y_bits, len(x) - SHINGLE + 1, len(y) - SHINGLE + 1, least):
                return False
            for key, line in ((a, x), (b, y)):
                if key not in sets:
                    sets[key] = shingle_sets([line])[0]
            return similar(sets[a], sets[b], least)

        def links() -> list[tuple[int, int]]:
            out = []
            clusters: dict[int, list[int]] = {}
            for key, root in group:
                for other in [*clusters]:
                    home = find(root)
                    if other == home or other != find(other):
                        continue
                    for k in clusters[other]:
                        if k == place[0] or key == place[0] or (k, key) in apart:
                            continue
                        if alike(key, k):
                            out.append((key, k))
                            parent[other] = home
                            clusters[home] = clusters.get(home, []) + clusters.pop(other)
                            break
                        apart.add((k, key))
                clusters.setdefault(find(root), []).append(key)
            return out

        for b in batches:
            found: list[tuple[int, int]] = []
            rows = [*zip(*(c.to_pylist() for c in b.columns))]
            lines = {r[4]: r[6] for r in rows}
            bits = dict(zip(lines, bitmaps([*lines.values()])))
            for first, lo, hi, band, key, root, line in rows:
                if (first, lo, hi) != place or band != band_now:
                    if len(group) > 1:
                        found += links()
                    group = []
                    if (first, lo, hi) != place:
                        place = (first, lo, hi)
                        known, sets, apart, parent = {}, {}, set(), {}
                    band_now = band
                known[key] = line, bits[key]
                group.append((key, root))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return work.mapInArrow(run, "a long, b long").distinct()


def _hot_bands(lines: DataFrame) -> list[int]:
    """Bands that more than one line in `HOT_SHARE` has, judged by one line in `HOT_SAMPLE`; 12 * HOT_SHARE at most.

    What is found here only decides how a band's rows travel, never what comes of them.
    """
    some = lines.where(F.col("bands").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(HOT_SAMPLE)) == 0)).select("bands")
    least = max(HOT_LEAST, some.count() // HOT_SHARE)
    return [r["band"] for r in some.select(F.explode("bands").alias("band")).groupBy("band").count().where(F.col("count") > least).collect()]


def _with_bucket(rows: DataFrame, hot: list[int], *measures: Column, where: str) -> DataFrame:
    """`rows` with the measures of their `band`, for bands where `where` holds.

    One exchange serves both the aggregate and the join. Rows of hot bands stay where
    they are: their aggregate combines before the shuffle and is a row for each of them.
    """

    def joined(part: DataFrame, way: str) -> DataFrame:
        return part.join(part.groupBy("band").agg(*measures).where(where).hint(way), "band")

    if not hot:
        return joined(rows.repartition("band"), "shuffle_hash")
    is_hot = F.col("band").isin(hot)
    return joined(rows.where(~is_hot).repartition("band"), "shuffle_hash").unionByName(joined(rows.where(is_hot), "broadcast"))


def _components(docs: DataFrame, lines: DataFrame, scratch: Scratch, min_chars: int, similarity: float) -> DataFrame:
    """Rows (node, root) of the keys that are similar to others."""
    hot = _hot_bands(lines)
    every = lines.where("bands is not null").select("key", F.explode("bands").alias("band"))
    met = _with_bucket(every, hot, F.min("key").alias("least"), F.max("key").alias("most"), where="least != most")
    # Several tasks may have met a line first.
    members = scratch.save(met.select("band", "key", "least").distinct(), "members")
    texts = scratch.save(_texts(docs, members, min_chars), "texts")
    pairs = members.where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    edges = scratch.save(_verified(pairs, texts, similarity), "edges")
    met_least = edges.select(F.col("a").alias("key"), F.col("b").alias("least"), F.lit(True).alias("joined"))
    rooted = members.join(met_least, ["key", "least"], "left").select("band", "key", "least", F.when(F.col("joined"), F.col("least")).otherwise(F.col("key")).alias("root"))
    split = _with_bucket(rooted, hot, F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"), where="x != y and n > 2")
    more = scratch.save(_verified_blocks(split.drop("x", "y"), texts, similarity), "more-edges")
    found = scratch.save(connected_components(edges.union(more), "a", "b", scratch), "components")
    scratch.drop(members, texts, edges, more)
    return found


def repeated_lines(df: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (row_key, doc_id, line_no, group, first): every line that is similar to another.

    `group` names the component, `first` says that the line is the one to keep.
    row_key is the hash of (doc_id, text).
    """
    if min_chars < 1:
        raise ValueError("min_chars must be 1 at least")
    docs = df.select(F.xxhash64(df[f"`{doc_id}`"], df[f"`{text}`"]).alias("row_key"), df[f"`{doc_id}`"].cast("long").alias("doc_id"), df[f"`{text}`"].cast("string").alias("text"))
    lines = scratch.save(_lines(docs, min_chars), "lines")
    found = _components(docs, lines, scratch, min_chars, similarity)
    grouped = lines.join(found.hint("shuffle_hash"), F.col("key") == F.col("node"), "left").select("row_key", "doc_id", "line_no", F.coalesce("root", "key").alias("group"))
    grouped = scratch.save(grouped, "grouped")
    scratch.drop(lines, found)
    # A saved table is on either side of the joins, so that Spark can split a very common line's rows.
    times = scratch.save(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("group"), "repeated")
    again = scratch.save(grouped.join(times.hint("shuffle_hash"), "group"), "again")
    scratch.drop(grouped, times)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("line_no").alias("n"), F.col("row_key").alias("r"))
    firsts = scratch.save(again.groupBy("group").agg(F.min(place).alias("least")), "firsts")
    return again.join(firsts.hint("shuffle_hash"), "group").select("row_key", "doc_id", "line_no", "group", (place == F.col("least")).alias("first"))


def deduplicate_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """`df` with repeated lines taken out of `text`, and `removed_lines` (int) beside."""
    scratch = Scratch(df.sparkSession, "lines")
    gone = repeated_lines(df, scratch, doc_id=doc_id, text=text, min_chars=min_chars, similarity=similarity).where("not first")
    key, numbers = fresh_name(df, "row_key"), fresh_name(df, "line_numbers")
    gone = gone.groupBy(F.col("row_key").alias(key)).agg(F.collect_set("line_no").alias(numbers))
    docs = df.withColumn(key, F.xxhash64(df[f"`{doc_id}`"], df[f"`{text}`"])).join(gone.hint("shuffle_hash"), key, "left")
    # A column of its own: inside the function over the lines the text would be split for each of them.
    parts = fresh_name(docs, "parts")
    docs = docs.withColumn(parts, F.when(F.col(numbers).isNotNull(), F.split(F.col(f"`{text}`"), "\n", -1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(numbers))
    rest = F.array_join(F.transform(keep, lambda i: F.get(F.col(parts), i)), "\n")
    columns = [F.when(F.col(numbers).isNull(), F.col(f"`{text}`")).otherwise(rest).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c != "removed_lines"]
    return docs.select(*columns, F.coalesce(F.size(numbers), F.lit(0)).alias("removed_lines"))
