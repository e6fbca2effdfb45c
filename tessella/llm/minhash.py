"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, Memo, Scratch, ascii_lower, bound_batches, fresh, hash_memo, mix, shingle_set, small, tidy
from .components import connected_components

#: 25 bands of 5: at a similarity of 0.85 a pair shares no band with odds of 4e-7, at 0.8 with 5e-5. Bits of a sketch: one a register.
BANDS, ROWS = 25, 5


def super_minhash(sets: list[np.ndarray], m: int, seed: int = 1, chunk: int = 1 << 16) -> np.ndarray:
    """Signatures of m registers (rows; infinite for empty sets). sets: arrays of 64-bit hashes.

    Step j gives each element the j-th place of its own random permutation of the registers and the value j plus a fraction, and a
    register keeps the least value. As a later step's values are larger, a set is done when all its registers are below the next
    step; a set of n elements takes about m log(m) / n steps, at most m. Steps run over all elements of a chunk at once."""
    out = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(items), chunk):
            x, d = items[lo : lo + chunk], owner[lo : lo + chunk]
            first, last = d[0], d[-1] + 1
            own = out[first:last]
            d = d - first
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            live = np.arange(len(x))
            for j in range(m):
                r = mix(x[live] + np.uint64(seed * 1_000_003 + 2 * j + 1) * np.uint64(0x9E3779B97F4A7C15))
                k = j + ((r >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
                place = order[live, k]
                order[live, k] = order[live, j]
                np.minimum.at(own, (d[live], place), j + (r & np.uint64((1 << 40) - 1)).astype(float) / (1 << 40))
                live = live[own.max(axis=1)[d[live]] > j + 1]
                if not len(live):
                    break
    return out


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature, as int64; the band's number is part of it."""
    bits = signatures.view(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros((len(bits), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
        for i in range(rows):
            acc = mix(acc * np.uint64(3) + bits[:, i : bands * rows : rows])
    return acc.view(np.int64)


def sketch_of(signatures: np.ndarray) -> np.ndarray:
    """One bit of each register, in two int64: two sets of similarity s agree in (1 + s) / 2 of them."""
    bits = (mix(signatures.view(np.uint64).copy()) & np.uint64(1)).astype(np.uint8)[:, :128]
    full = np.zeros((len(bits), 128), np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.int64)


def sketch_limit(m: int, percent: int) -> int:
    """Bits that pairs of at least this similarity differ in, but for odds of 1e-9 (six deviations)."""
    q = (1 - percent / 100) / 2
    return int(np.ceil(m * q + 6 * (m * q * (1 - q)) ** 0.5))


def text_key(text):
    """128 bits of a text's words, lower-cased: texts with equal words have equal shingles. Null without words."""
    plain = F.btrim(F.regexp_replace(ascii_lower(text), GAP, " "))
    return F.when(F.char_length(plain) > 0, F.unhex(F.md5(plain)))


def of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, text) whose text has that key; text may be null."""
    for b in batches:
        good = [t is not None and hashlib.md5(b" ".join(t.lower().split())).digest() == k for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns], names=["key", "text"])


def signed(docs: DataFrame, id_col: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, key, n (size of the shingle set), bands, s0, s1 (sketch) of each row; without words n is 0 and the rest null."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            for lo in range(0, len(b), 256):
                ids, texts = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256).to_pylist()
                words = [t.lower().split() if t else [] for t in texts]
                sets = [shingle_set(w, k, memo) for w in words]
                sig = super_minhash(sets, bands * rows)
                has = [len(s) > 0 for s in sets]
                band, sketch = bands_of(sig, bands, rows), sketch_of(sig)
                yield pa.RecordBatch.from_arrays([
                    ids,
                    pa.array([hashlib.md5(b" ".join(w)).digest() if w else None for w in words], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x if h else None for x, h in zip(band, has, strict=True)], pa.list_(pa.int64())),
                    *(pa.array([int(x) if h else None for x, h in zip(sketch[:, i], has, strict=True)], pa.int64()) for i in range(2)),
                ], names=["id", "key", "n", "bands", "s0", "s1"])

    return docs.select(id_col, F.col(text).cast("binary")).mapInArrow(tidy(run), f"id {kind}, key binary, n bigint, bands array<bigint>, s0 bigint, s1 bigint")


def measured(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs a, b of keys with the sizes na, nb of their full shingle sets and of what these share. texts: key, text (binary)."""
    left, right = (texts.select(F.col("key").alias(f"k{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    rows = pairs.join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        sets = Memo(lambda t: shingle_set(t.lower().split(), k, memo), limit=64)
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = sets[x], sets[y]
                out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            more = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *more], names=["a", "b", "na", "nb", "both"])

    bound_batches(pairs.sparkSession)
    return rows.mapInArrow(tidy(run), "a binary, b binary, na bigint, nb bigint, both bigint")


def differences(pairs: DataFrame, texts: DataFrame, k: int, most: int = 256) -> DataFrame:
    """dkey, dhead, d: the shingles that just one of two texts has, for pairs key, head; null if these are more than `most`."""
    left, right = (texts.select(F.col("key").alias(f"k{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    rows = pairs.join(left, F.col("key") == F.col("ka")).join(right, F.col("head") == F.col("kb")).select("key", "head", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        sets = Memo(lambda t: shingle_set(t.lower().split(), k, memo), limit=64)
        for b in batches:
            each = [np.setxor1d(sets[x], sets[y], assume_unique=True) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([d.view(np.int64) if len(d) <= most else None for d in each], pa.list_(pa.int64()))], names=["dkey", "dhead", "d"])

    return rows.mapInArrow(tidy(run), "dkey binary, dhead binary, d array<bigint>")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the measured pairs with 100 * intersection >= percent * union."""
    return pairs.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


#: Members of a bucket that all its others are verified against before pairs are looked at one by one.
PIVOTS = 6
def lone_shingles(texts: DataFrame, k: int) -> DataFrame:
    """ukey, u: how many shingles of a text no other of the texts has. Without any there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            sets = [shingle_set(t.lower().split(), k, memo).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["ukey", "shingles"])

    each = texts.select("key", "text").mapInArrow(tidy(run), "ukey binary, shingles array<bigint>").select("ukey", F.explode("shingles").alias("s"))
    return each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("ukey").alias("ukey")).where("n = 1").groupBy("ukey").agg(F.count(F.lit(1)).alias("u"))


def near_groups(units: DataFrame, texts: Callable[[DataFrame, int], DataFrame], scratch: Scratch, m: int, k: int, percent: int, total: int) -> DataFrame:
    """node, root: the keys linked, directly or through others, with a smaller key, and the smallest of them.

    units: key (distinct), n (size of the shingle set, 0 if not known), bands, s0, s1; texts: makes key, text (binary) for a table of keys and its number of rows. total: rows of the table behind units, or more.

    Buckets with one key go first. Then all members of a bucket are measured against its PIVOTS most central ones, those whose buckets hold most keys over all bands: a
    group of many copies of one text has a copy near that text among them, and grows together with a few pairs for each member. Last, pairs of a bucket that still lie in different
    components are measured one by one: a bucket's largest component needs none within itself, so these are its other members against all.
    Of these, pairs are left out only where a link is impossible: by sizes; by sketches (but for odds of 1e-9); by shingles that no other text has; and by what
    both texts' differences from each of the bucket's pivots can have in common: two sets differ by their differences from a third one, less twice
    what these share. What is left is decided by the differences from the first pivot themselves, where they are few, before a pair is made; so copies of one
    text that aren't near each other make no pairs.
    Nothing but counts reaches the driver."""
    spread = units.select("key", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("band").alias("of"), "times")
    live = spread.join(shared, F.col("band") == F.col("of")).groupBy("key").agg(F.collect_set("band").alias("bands"), F.sum("times").alias("weight"))
    live = scratch.put(units.drop("bands").join(live, "key"), "live", max(1, total // 4_000))
    rows = live.count()
    few, some = max(1, rows // 4_000), max(24, rows // 2_000)
    texts = scratch.put(texts(live.select("key"), rows), "texts", tasks=some)
    members = live.select("key", "n", "s0", "s1", "weight", F.explode("bands").alias("band"))
    limit = sketch_limit(min(m, 128), percent)
    sized = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    alike = F.bit_count(F.col("s0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("p1"))) <= limit
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("weight"), "key"))).where(F.col("r") <= PIVOTS)
    heads = ranked.groupBy(F.col("band").alias("pband")).agg(F.array_sort(F.collect_list(F.struct("r", "key", "n"))).alias("heads"))
    heads = scratch.put(heads, "heads", max(1, rows // 10_000))
    # a member meets its buckets' pivots once each, however many buckets they share
    met = members.join(heads, F.col("band") == F.col("pband")).groupBy("key", "n").agg(F.array_distinct(F.flatten(F.collect_set(F.transform("heads", lambda h: F.struct(h["key"].alias("key"), h["n"].alias("n")))))).alias("h"))
    met = met.select("key", F.explode(F.transform(F.filter("h", lambda h: (h["key"] != F.col("key")) & (100 * F.least(h["n"], F.col("n")) >= percent * F.greatest(h["n"], F.col("n")))), lambda h: h["key"])).alias("pkey"))
    met = scratch.put(met.select("key", "pkey", F.least("key", "pkey").alias("a"), F.greatest("key", "pkey").alias("b")), "met", few)
    pair = (F.least("key", "pkey").alias("a"), F.greatest("key", "pkey").alias("b"))
    pairs = scratch.put(measured(met.select("a", "b").distinct(), texts, k), "pairs", tasks=some)
    links = linked(pairs, percent)
    roots = connected_components(links, scratch, "first")
    rows = members.join(roots, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root", "weight")
    sizes = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
    major = sizes.groupBy("band").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("all")).where(f"kinds > 1 and all > {PIVOTS + 1}").select(F.col("band").alias("mband"), "major")
    mixed = scratch.put(rows.join(major, F.col("band") == F.col("mband")).drop("mband"), "mixed", few)
    if not mixed.isEmpty():
        wanted = mixed.select(F.col("key").alias("want")).distinct()
        lone = lone_shingles(texts.join(wanted, F.col("key") == F.col("want"), "left_semi"), k)
        # per member: what it lacks of each of its buckets' pivots, and has beside it
        way = met.join(wanted, F.col("key") == F.col("want"), "left_semi").withColumnRenamed("key", "x").join(pairs, ["a", "b"])
        own, other = (F.when(F.col("x") == F.col("a"), F.col(c)).otherwise(F.col(d)) for c, d in (("na", "nb"), ("nb", "na")))
        way = way.groupBy(F.col("x").alias("skey")).agg(F.max(own).alias("sn"), F.collect_list(F.struct(F.col("pkey").alias("y"), (other - F.col("both")).alias("lost"), (own - F.col("both")).alias("new"))).alias("way"))
        known = mixed.join(heads, F.col("band") == F.col("pband")).join(lone, F.col("key") == F.col("ukey"), "left").join(way, F.col("key") == F.col("skey"), "left")

        def side(i: int, name: str):
            h = F.get("heads", F.lit(i - 1))["key"]
            return F.when(h == F.col("key"), F.lit(0).cast("long")).otherwise(F.get(F.filter("way", lambda w: w["y"] == h), F.lit(0))[name]).alias(f"{name}{i}")

        sides = [f"{name}{i}" for i in range(1, PIVOTS + 1) for name in ("lost", "new")]
        known = known.select("band", "key", F.coalesce("sn", "n").alias("n"), "s0", "s1", "comp", "major", F.coalesce("u", F.lit(0)).alias("u"), F.get("heads", F.lit(0))["key"].alias("head"), *(side(i, name) for i in range(1, PIVOTS + 1) for name in ("lost", "new")))
        apart = differences(known.where("key <> head").select("key", "head").distinct(), texts, k)
        known = known.join(apart, (F.col("key") == F.col("dkey")) & (F.col("head") == F.col("dhead")), "left")
        d = F.when(F.col("key") == F.col("head"), F.array().cast("array<bigint>")).otherwise(F.col("d"))
        mixed = scratch.put(known.withColumn("d", d).drop("head", "dkey", "dhead"), "known", tasks=some)
        minor = mixed.where("comp <> major").select(F.col("band").alias("pband"), *(F.col(c).alias(d) for c, d in (("key", "pkey"), ("n", "pn"), ("s0", "p0"), ("s1", "p1"), ("comp", "pcomp"), ("u", "pu"), *((c, f"p{c}") for c in (*sides, "d")))))
        total = F.col("n") + F.col("pn")
        both = F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu"))
        can = (total == 0) | (100 * both >= percent * (total - both))
        reach = F.lit(True)
        for i in range(1, PIVOTS + 1):
            lost, new, plost, pnew = (F.col(f"{c}{i}") for c in ("lost", "new", "plost", "pnew"))
            share = F.least(lost, plost) + F.greatest(F.least(new - F.col("u"), pnew - F.col("pu")), F.lit(0))
            reach = reach & F.coalesce((100 + percent) * (lost + new + plost + pnew - 2 * share) <= (100 - percent) * total, F.lit(True))
        exact = F.coalesce((100 + percent) * (F.size("d") + F.size("pd") - 2 * F.size(F.array_intersect("d", "pd"))) <= (100 - percent) * total, F.lit(True))
        cross = (F.col("comp") != F.col("pcomp")) & ((F.col("comp") == F.col("major")) | (F.col("key") < F.col("pkey")))
        found = mixed.join(minor, (F.col("band") == F.col("pband")) & cross & sized & alike & can & reach & exact)
        rest = found.select(*pair).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        more = scratch.put(linked(measured(rest, texts, k), percent), "more", tasks=some)
        if not more.isEmpty():
            roots = connected_components(links.union(more), scratch, "last")
    scratch.drop("texts", "mixed", "known", "pairs", "heads", "met")
    return roots


def grouped(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key, n_shingles, component_id, comp for each row of docs: the smallest id of the row's group, and a key of the group (null for itself alone).

    Shingles are k words, A-Z lower-cased; a text with fewer words is one shingle, and without words or null it is empty and linked with nothing: its
    component_id is its own id. Texts with equal words are one class, which is signed and verified once however many copies it has.
    Ids that repeat take part row by row. A null id counts in a group, but is its component_id only where no row of the group has another."""
    scratch = Scratch(spark, "minhash")
    sig = scratch.put(signed(docs, id_col, text, k, bands, rows), "signed")
    units = sig.where("key is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "bands", "s0", "s1")))
    one = sig.where("key is not null").groupBy("key").agg(F.min("id").alias("id")).select(F.col("id").alias("_id"), F.col("key").alias("_key"))

    def texts(keys: DataFrame, n: int) -> DataFrame:
        wanted = scratch.put(one.join(keys, F.col("_key") == F.col("key"), "left_semi"), "wanted", max(1, n // 20_000))
        got = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t")).join(small(wanted), F.col("id").eqNullSafe(F.col("_id")))
        return got.select("_key", "t").mapInArrow(of_key, "key binary, text binary").dropDuplicates(["key"])

    total = sig.count()
    roots = near_groups(units, texts, scratch, bands * rows, k, percent, total)
    named = sig.drop("bands", "s0", "s1").join(roots, F.col("key") == F.col("node"), "left").select("id", "key", F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("comp"))
    named = scratch.put(named, "named", max(1, total // 20_000))
    scratch.drop("signed")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("comp").alias("of"), "least")
    out = named.join(least, F.col("comp") == F.col("of"), "left")
    return out.select("id", "key", "n_shingles", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "comp")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of docs for each group of near duplicates, that of the smallest id, with the columns of docs.

    Texts without words are in no group and all stay. Of rows that agree in id and words one stays."""
    gone_id, gone_key, at = fresh(docs, "_gone_id", "_gone_key", "_text_key")
    scratch = Scratch(spark, "near")
    rows = scratch.put(grouped(spark, docs, id_col, text, k, percent, **options).where("key is not null"), "rows")
    few = max(1, rows.count() // 50_000)
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(F.col("comp").alias("of")).agg(F.min(F.struct("id", "key")).alias("f"))
    judged = rows.join(first, F.col("comp") == F.col("of")).withColumn("stays", F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key")))
    gone = scratch.put(judged.where("not stays").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "gone", few)
    twice = scratch.put(judged.where("stays").groupBy(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(gone_id, gone_key), "twice", few)
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(at) == F.col(gone_key))
    left = docs.withColumn(at, text_key(F.col(text))).join(small(gone), same, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    twice = small(twice)
    return left.join(twice, same, "left_anti").select(*docs.columns).union(left.join(twice, same, "left_semi").dropDuplicates([id_col, at]).select(*docs.columns))
