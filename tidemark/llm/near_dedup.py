"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Every distinct text is a weighted set of five-word shingles. Its sketch holds, for each of SAMPLES
independent functions, the element and level that improved consistent weighted sampling draws; two
sketches agree in one place with the probability of their weighted Jaccard similarity. Beside it stand as many
least hashes of the plain set, which agree with the probability of the plain similarity. Bands of three places of either make
buckets. Within a bucket texts are never paired freely: first each text meets a few centres of
its buckets and its best match is verified; connected texts form classes. Then, only in buckets that still
hold several classes, the texts outside the bucket's largest class meet the bucket's other classes in
blocks, and pairs whose sketches agree enough are verified. Verification reads the whole shingle sets.

The weight of a shingle is tf x idf, idf = ln(1 + T / c) / ln(1 + B) with c the count of the shingle's
cell among B cells and T the sum of all cells over the corpus: 1 for a shingle of usual rarity. As idf
falls with the size of a group of copies, large groups would come apart by their own size; a pair is therefore
also linked when its unweighted Jaccard similarity reaches the threshold.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import in_plane, plane_of, rows_in_plane
from tidemark.llm.textwords import bounded_batches, column_of, give_back, grams, mixed, text_slices, words_of
from tidemark.session import pin

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS, SAMPLES = 16, 3, 64
CELLS, PARAMS = 1 << 18, 1 << 14
MIN_AGREEMENT = 0.6  # of two sketches in either half, before a pair is verified; 0.8 less four standard deviations
BLOCK, SLICE = 512, 8192  # texts that ask and texts that answer in one unit
PART = 8192  # elements sampled at once


@lru_cache(maxsize=2)
def _parameters(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    r = rng.gamma(2.0, 1.0, (PARAMS, SAMPLES))
    c = rng.gamma(2.0, 1.0, (PARAMS, SAMPLES))
    beta = rng.random((PARAMS, SAMPLES))
    return r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32)


def shingles_of(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, 32-bit shingles and their counts; sorted, each once per row. A text of fewer words is one shingle."""
    w = words_of(texts)
    h, whole = grams(w, n)
    sizes = np.diff(w.first)
    rows, values = w.row[whole], h[whole]
    for k in range(1, n):
        short = np.flatnonzero(sizes == k)
        if len(short):
            g, _ = grams(w, k)
            rows = np.concatenate([rows, short])
            values = np.concatenate([values, g[w.first[short]]])
    packed = np.sort(rows.astype(np.uint64) << np.uint64(32) | values >> np.uint64(32))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(packed)]]))
    packed = packed[first]
    return (packed >> np.uint64(32)).astype(np.int64), packed.astype(np.uint32), count


def sketches(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """rows x SAMPLES 32-bit samples; rows without a shingle have zeros."""
    r, log_c, beta = _parameters(seed)
    low = np.full((rows, SAMPLES), np.inf, np.float32)
    sample = np.zeros((rows, SAMPLES), np.uint32)
    column = np.arange(SAMPLES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    log_w = np.log(weight).astype(np.float32)
    for a in range(0, len(row), PART):
        own, s = row[a : a + PART], shingle[a : a + PART]
        p = (s >> np.uint32(18)) & np.uint32(PARAMS - 1)
        scale = r[p]
        shift = beta[p]
        level = np.floor(log_w[a : a + PART, None] / scale + shift)
        value = log_c[p]
        value -= scale * (level - shift + np.float32(1))
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(value, starts, axis=0)
        group = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
        i, k = np.nonzero(value == least[group])
        key = (mixed(s[i].astype(np.uint64) << np.uint64(24) ^ (level[i, k].astype(np.int64) & 0xFFFFFF).astype(np.uint64) ^ column[0, k]) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(key, kind="stable")[::-1]  # among equal values the smallest sample is written last
        found = np.zeros(least.shape, np.uint32)
        found[group[i[order]], k[order]] = key[order]
        docs = own[starts]
        old, was = low[docs], sample[docs]
        better = (least < old) | ((least == old) & (found < was))
        low[docs] = np.where(better, least, old)
        sample[docs] = np.where(better, found, was)
    return sample


def plain_sketches(row: np.ndarray, shingle: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """rows x SAMPLES least hashes of the sets; rows without a shingle have the greatest number."""
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    flip = rng.integers(0, 1 << 64, SAMPLES, np.uint64)
    by = rng.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)
    out = np.full((rows, SAMPLES), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(row), PART):
        own = row[a : a + PART]
        h = ((mixed(shingle[a : a + PART].astype(np.uint64) + np.uint64(1))[:, None] ^ flip) * by >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[starts]] = np.minimum(out[own[starts]], np.minimum.reduceat(h, starts, axis=0))
    return out


def both_sketches(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """rows x 2 SAMPLES 16-bit samples: of the weighted set, then of the plain one."""
    plain = mixed(plain_sketches(row, shingle, rows, seed).astype(np.uint64))
    return np.concatenate([sketches(row, shingle, weight, rows, seed), plain], 1).astype("<u2")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row the larger share of equal samples among the weighted and the plain ones."""
    return (x == y).reshape(-1, 2, SAMPLES).sum(2, dtype=np.uint8).max(1) / SAMPLES


def bands_of(x: np.ndarray) -> np.ndarray:
    """rows x 2 BANDS hashes of ROWS samples each."""
    x = x.astype(np.uint64)
    out = []
    for b in range(2 * BANDS):
        h = np.full(len(x), b + 1, np.uint64)
        first = b // BANDS * SAMPLES + b % BANDS * ROWS
        for k in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[:, first + k])
        out.append(h.view(np.int64))
    return np.stack(out, 1)


def cell_counts(docs: DataFrame) -> np.ndarray:
    """Documents per cell of shingles over the whole corpus: CELLS numbers, summed in tasks by cell range."""
    chunk = CELLS // 16

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for part in text_slices(batches, "_text"):
            total += np.bincount(shingles_of(column_of(part, "_text"))[1] & (CELLS - 1), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([total[k * chunk : (k + 1) * chunk].astype("<i8").tobytes() for k in range(16)], pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(CELLS, np.int64)
    counted = docs.select("_text").mapInArrow(count, "chunk int, counts binary").repartition(16, "chunk").mapInArrow(add, "chunk int, counts binary")
    for k, raw in counted.collect():  # CELLS numbers in all
        out[k * chunk : (k + 1) * chunk] = np.frombuffer(raw, "<i8")
    return out


def idf_of(cells: np.ndarray) -> np.ndarray:
    total = max(1, int(cells.sum()))
    return (np.log1p(total / np.maximum(cells, 1)) / np.log1p(CELLS)).astype(np.float32)


def similarities(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, idf: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two sorted shingle sets with counts."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    wa, wb = na * idf[a & (CELLS - 1)].astype(np.float64), nb * idf[b & (CELLS - 1)].astype(np.float64)
    shared = np.minimum(wa[i], wb[j]).sum()
    union = wa.sum() + wb.sum() - shared
    size = len(a) + len(b) - len(both)
    return (shared / union if union else 0.0), (len(both) / size if size else 0.0)


def _agreeing(batches):
    """(a, b, agreement) of the pairs whose sketches ``_a`` and ``_b`` agree enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(column_of(batch, c).to_pylist()), "<u2").reshape(batch.num_rows, 2 * SAMPLES) for c in ("_a", "_b"))
        share = agreement(x, y)
        keep = pa.array(np.flatnonzero(share >= MIN_AGREEMENT))
        yield pa.RecordBatch.from_arrays([column_of(batch, "a").take(keep), column_of(batch, "b").take(keep), pa.array(share).take(keep)], ["a", "b", "agreement"])


def verified(pairs: DataFrame, features: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Those ``pairs(a, b)`` whose whole shingle sets are similar enough."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def similar(batches):
        for batch in batches:
            sets = zip(*(column_of(batch, c).to_pylist() for c in ("_sa", "_ca", "_sb", "_cb")))
            # Rounded, so that a similarity of exactly the threshold counts.
            keep = [k for k, x in enumerate(sets) if max(similarities(*(np.frombuffer(v, "<u4") for v in x), table.value)) >= threshold - 1e-9]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "a").take(keep), column_of(batch, "b").take(keep)], ["a", "b"])
        give_back()

    left = features.select(F.col("key").alias("a"), F.col("shingles").alias("_sa"), F.col("counts").alias("_ca"))
    right = features.select(F.col("key").alias("b"), F.col("shingles").alias("_sb"), F.col("counts").alias("_cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_sa", "_ca", "_sb", "_cb").mapInArrow(similar, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in ``links(a, b)``; root is the least key of its component.

    Least labels spread along links and labels jump to their label's label, so long chains halve
    in each round. Every round is written to the shared folder.
    """
    both = pin(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = pin(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        spread = labels.join(near, labels["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("next"))
        moved = pin(spread.join(jump, "root", "left").select("key", "was", F.least("root", "next").alias("root")), "labels")
        labels = moved.select("key", "root")
        if moved.where(F.col("root") != F.col("was")).isEmpty():
            return labels


def _hex(name: str) -> Column:
    return F.lower(F.hex(name))


def text_key(text: Column) -> Column:
    """The first 128 bits of the text's SHA-256, as hexadecimal digits."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, n_copies, kept, text_key, class_key.

    A class is a set of texts connected by pairs of at least ``threshold`` similarity, with all their exact
    copies; class_id is the smallest id in it and the row with that id is kept (of several, one text). Texts are compared once,
    however many rows have them (n_copies). A null text is an empty text; empty texts, like texts without a word, are
    alike only when identical. A text of fewer than five words is one shingle of all its words.
    Null ids come last. Rows that repeat id and text share their answer. Other columns are not read.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("_id"), F.unhex(text_key(text)).alias("key"), text.alias("_text"))
    idf = idf_of(cell_counts(given))
    table = spark.sparkContext.broadcast(idf)
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches):
        for part in text_slices(batches, "_text"):
            n = part.num_rows
            row, shingle, count = shingles_of(column_of(part, "_text"))
            sample = both_sketches(row, shingle, count * table.value[shingle & (CELLS - 1)], n, seed)
            cut = np.searchsorted(row, np.arange(n + 1)).tolist()
            shingle, count = shingle.astype("<u4"), count.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                column_of(part, "_id"), column_of(part, "key"),
                pa.array([s.tobytes() for s in sample], pa.binary()),
                pa.array([shingle[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                pa.array([count[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["_id", "key", "sketch", "shingles", "counts"])

    rows = pin(given.mapInArrow(sketch, f"_id {kind}, key binary, sketch binary, shingles binary, counts binary"), "sketches")
    texts = pin(rows.where(F.length("shingles") > 0).groupBy("key").agg(F.first("sketch").alias("sketch")), "texts")

    def members_of(chosen=None, bits: int = 0) -> DataFrame:
        """(key, band) of each text, of the bands that may be in the filter ``chosen`` if one is given."""
        def bands(batches):
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, 2 * SAMPLES)
                found = bands_of(x)
                hit = in_plane(chosen.value, found.ravel(), bits).reshape(found.shape) if chosen is not None else np.ones(found.shape, bool)
                cut = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(found[hit]))], ["key", "bands"])

        return texts.select("key", "sketch").mapInArrow(bands, "key binary, bands array<long>").select("key", F.explode("bands").alias("band"))

    # Most bands are of one text. They are counted alone, and texts meet in the others.
    repeated = pin(members_of().groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "repeated")
    plane, bits = plane_of(repeated.select(F.col("band").alias("h")))
    member = pin(members_of(spark.sparkContext.broadcast(plane), bits), "meeting")
    # Four centres of each bucket, whatever its size; buckets of one text go.
    centre = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(
        F.min("key"), F.max("key"), F.min_by("key", F.xxhash64("key", F.lit(1))), F.min_by("key", F.xxhash64("key", F.lit(2))))).alias("c")).where("n > 1")
    centre = pin(centre, "centres")
    shared = pin(member.join(centre.select("band", "c"), "band"), "buckets")

    def scored(pairs: DataFrame) -> DataFrame:
        s = texts.select("key", "sketch")
        pairs = pairs.join(s.select(F.col("key").alias("a"), F.col("sketch").alias("_a")), "a").join(s.select(F.col("key").alias("b"), F.col("sketch").alias("_b")), "b")
        return pairs.select("a", "b", "_a", "_b").mapInArrow(_agreeing, "a binary, b binary, agreement double")

    met = scored(shared.select(F.col("key").alias("a"), F.explode("c").alias("b")).where("a <> b").distinct())
    best = pin(met.groupBy("a").agg(F.max_by("b", F.struct("agreement", "b")).alias("b")), "best")

    def features_of(needed: DataFrame) -> DataFrame:
        """Sketches and shingles of the texts in ``needed(key)``; rows that a filter of its keys rules out are not shuffled."""
        plane, bits = plane_of(needed.select(F.xxhash64("key").alias("h")))
        may = rows_in_plane(rows.withColumn("_h", F.xxhash64("key")), "_h", spark.sparkContext.broadcast(plane), bits, True)
        return may.join(needed, "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("sketch", "shingles", "counts")])

    ends = pin(best.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends")
    links = pin(verified(best, features_of(ends), idf, threshold), "verified")
    roots = components(links)

    # Buckets that still hold several classes: texts outside the largest class ask, in blocks, all others. A unit
    # is a block of askers and a slice of the bucket, both of bounded size, so no bucket fills a task.
    placed = pin(shared.select("key", "band").join(roots, "key", "left").select("key", "band", F.coalesce("root", "key").alias("root")), "placed")
    classes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    several = classes.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("top")).where("k > 1")
    several = pin(several.select("band", "main", F.ceil((F.col("n") - F.col("top")) / BLOCK).alias("blocks"), F.ceil(F.col("n") / SLICE).alias("slices")), "several")
    members = pin(placed.join(several, "band"), "members")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    asks = F.when(F.col("root") != F.col("main"), F.transform(upto("slices"), lambda x: F.struct(F.lit(0).alias("role"), own("blocks").alias("block"), x.alias("slice"))))
    answers = F.transform(upto("blocks"), lambda x: F.struct(F.lit(1).alias("role"), x.alias("block"), own("slices").alias("slice")))
    none = F.array().cast("array<struct<role:int,block:bigint,slice:bigint>>")

    def in_units(table: DataFrame, *columns: str) -> DataFrame:
        spread = table.select("band", "key", "root", *columns, F.explode(F.concat(F.coalesce(asks, none), answers)).alias("u"))
        spread = spread.select("band", "u.block", "u.slice", "u.role", "key", "root", *columns)
        return spread.repartition(n, "band", "block", "slice").sortWithinPartitions("band", "block", "slice", "role")

    def screen(batches):
        """(band, key) of texts whose sketch agrees enough with one of another class; no shingles are needed for the others."""
        unit, askers, sketch, hit = None, [], None, None

        def found():
            return [askers[k][0] for k in np.flatnonzero(hit).tolist()] if hit is not None else []

        for batch in batches:
            bands, keys = [], []
            columns = [column_of(batch, c).to_pylist() for c in ("band", "block", "slice", "role", "key", "root", "sketch")]
            for band, block, part, role, key, root, raw in zip(*columns):
                if unit != (band, block, part):
                    late = found()
                    bands += [unit[0]] * len(late) if late else []
                    keys += late
                    unit, askers, sketch, hit = (band, block, part), [], None, None
                if role == 0:
                    askers.append((key, root, raw))
                    continue
                if not askers:
                    continue
                if sketch is None:
                    sketch = np.frombuffer(b"".join(x[2] for x in askers), "<u2").reshape(len(askers), 2 * SAMPLES)
                    number = {r: k for k, r in enumerate(dict.fromkeys(x[1] for x in askers))}
                    roots = np.array([number[x[1]] for x in askers])
                    hit = np.zeros(len(askers), bool)
                near = (agreement(sketch, np.frombuffer(raw, "<u2")) >= MIN_AGREEMENT) & (roots != number.get(root, -1))
                if near.any():
                    hit |= near
                    bands.append(band)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int64()), pa.array(keys, pa.binary())], ["band", "key"])
        late = found()
        if late:
            yield pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(late), pa.int64()), pa.array(late, pa.binary())], ["band", "key"])
        give_back()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = members.join(texts, "key")
    close = pin(in_units(sketched, "sketch").mapInArrow(screen, "band long, key binary").distinct(), "close")
    members = members.join(close, ["band", "key"], "left_semi")
    asked = pin(close.select("key").distinct(), "asked")
    units = in_units(members.join(features_of(asked), "key"), "sketch", "shingles", "counts")

    def meet(batches):
        unit, askers, sketch = None, [], None
        joined: dict[bytes, bytes] = {}

        def find(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            a, b = [], []
            columns = [column_of(batch, c).to_pylist() for c in ("band", "block", "slice", "role", "key", "root", "sketch", "shingles", "counts")]
            for band, block, part, role, key, root, raw, shingles, counts in zip(*columns):
                if unit != (band, block, part):
                    unit, askers, sketch, joined = (band, block, part), [], None, {}
                if role == 0:
                    askers.append((key, root, raw, shingles, counts))
                    continue
                if not askers:
                    continue
                if sketch is None:
                    sketch = np.frombuffer(b"".join(x[2] for x in askers), "<u2").reshape(len(askers), 2 * SAMPLES)
                share = agreement(sketch, np.frombuffer(raw, "<u2"))
                for k in np.flatnonzero(share >= MIN_AGREEMENT).tolist():
                    other, far, _, s, c = askers[k]
                    x, y = find(root), find(far)
                    if x != y and max(similarities(*(np.frombuffer(v, "<u4") for v in (shingles, counts, s, c)), table.value)) >= threshold - 1e-9:
                        joined[max(x, y)] = min(x, y)  # classes that one link of the unit joins need no other
                        a.append(min(key, other))
                        b.append(max(key, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        give_back()

    late = pin(units.mapInArrow(meet, "a binary, b binary").distinct(), "late")
    if not late.isEmpty():
        roots = components(links.unionByName(late))

    of_row = pin(rows.select("_id", "key").join(roots, "key", "left").select("_id", "key", F.coalesce("root", "key").alias("root")), "rows")
    order = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("key").alias("k"))
    groups = pin(of_row.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    copies = pin(of_row.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies")), "copies")
    kept = F.col("_id").eqNullSafe(F.col("first.i")) & (F.col("key") == F.col("first.k"))
    return of_row.join(groups, "root").join(copies, "key").select(
        F.col("_id").alias(id_col), F.col("first.i").alias("class_id"), "class_size", "n_copies", kept.alias("kept"), _hex("key").alias("text_key"), _hex("root").alias("class_key"))
