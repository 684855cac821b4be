"""Same or near-same records across splits (problem 1).

Records are reduced to distinct keys (title, title without subtitle, checksum), so that copies are compared once. Titles
are joined by an exact prefix filter: the grams of every key are brought in one order, by how often they occur, rare ones first;
evaluation keys are indexed under their rarest grams and training keys probe with theirs. If at most k slips part two
keys, and a slip can touch at most GRAM + 1 grams, then the k * (GRAM + 1) + 1 rarest grams of either must meet the
other's, so no pair is lost. Length and position filters drop candidates, and the edit distance decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.chars import code_points, with_plain
from quirefold.session import cut

GRAM = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKET_SHIFT = np.uint64(44)  # grams are counted by their first 20 bits
HOT_GRAM = 100_000  # training keys of a gram that one task meets
SALTS = 8  # a title or checksum that very many records share is met by so many tasks on either side
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
TRAINING = ("discovery",)
EVALUATION = ("development", "locked-test", "control")

# What numbers a part of a series, remarks on edition or format, and leading articles.
PART_WORDS = "vol|volume|vols|part|parts|band|bd|teil|tome|tomo|book|number|no|nr|issue|yearbook|jahrbuch|annual|annals|heft|folge|series|том|часть"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\\d+(?:st|nd|rd|th)|\\d+\\."
EDITION_WORDS = (
    "new|revised|rev\\.?|enlarged|expanded|updated|corrected|illustrated|abridged|unabridged|annotated|digital|electronic|online|printed|print|paperback|hardback|hardcover|softcover|student|special|limited|"
    "international|facsimile|reprinted|reprint|open access|free|full text|large|pdf|epub|e-?book|kindle|html|scanned|scan|audiobook|web|resource|download|format|copy|version|printing|edition|edn\\.?|ed\\.?|ausgabe|auflage"
)
SURE_WORDS = "revised|expanded|enlarged|updated|electronic|digital|facsimile|edition|reprint"
REMARK = f"(?:(?:{ORDINALS}|{EDITION_WORDS})(?:[\\s,]+(?:and\\s+)?(?:{ORDINALS}|{EDITION_WORDS}))*)"
EDITION = f"(?:(?:{ORDINALS}|revised|new|enlarged|updated|corrected)\\s+)+(?:edition|edn\\.?|ed\\.?)"
ARTICLES = "the|a|an|der|die|das|le|la|les|el|los|las"


def sha_key(sha: Column, size: Column) -> Column:
    """The checksum as 64 small hex digits whatever its notation; null for none, a malformed one or an empty file."""
    bare = F.regexp_replace(F.lower(F.trim(sha)), "^(sha-?256)?[:=\\s]*(0x)?", "")
    bare = F.regexp_replace(bare, "[\\s:-]", "")
    ok = bare.rlike("^[0-9a-f]{64}$") & (bare != EMPTY_SHA256) & ((size.isNull()) | (size != 0))
    return F.when(ok, bare)


def title_parts(records: DataFrame, title: str) -> DataFrame:
    """``records`` with ``full`` and ``main`` (letters and digits of the title, and of it without its subtitle), ``numbers`` (what tells volumes, parts and years apart) and ``has_sub``."""
    rows = with_plain(records, title, "_t", context=True)
    # Each step is a column of its own, as what is read twice would be computed twice; patterns run only where their sign occurs.
    step = lambda c: rows.withColumn("_t", c)
    t = F.col("_t")
    rows = step(F.regexp_replace(F.lower(F.upper(t)), "[\\s\\u00a0]+", " "))
    rows = step(F.when(t.rlike("[&＆]"), F.regexp_replace(F.trim(t), "\\s*[&＆]\\s*", " and ")).otherwise(F.trim(t)))
    # Remarks in brackets anywhere, or at the end after punctuation.
    rows = step(F.when(t.rlike("[(\\[{]"), F.regexp_replace(t, f"\\s*[\\(\\[\\{{]\\s*{REMARK}\\s*[\\)\\]\\}}]", "")).otherwise(t))
    for _ in range(2):
        rows = step(F.when(t.rlike("[,;:.–—/-]"), F.regexp_replace(t, f"\\s*(?:[,;:.–—-]|\\s/)\\s*{REMARK}[\\s.]*$", "")).otherwise(t))
    rows = step(F.when(t.rlike("ed(?:ition|n)?\\.?[\\s.]*$"), F.regexp_replace(t, f"\\s+{EDITION}[\\s.]*$", "")).otherwise(t))
    # A remark of two words with a slip in one of them.
    slip = f"\\s*(?:[,;/(\\[]|\\s[–—-])\\s*(?:(?:{SURE_WORDS})\\s+\\p{{L}}{{3,11}}|\\p{{L}}{{3,11}}\\s+(?:{SURE_WORDS}))[\\s.)\\]]*$"
    rows = step(F.when(t.rlike(f"(?:{SURE_WORDS})"), F.regexp_replace(t, slip, "")).otherwise(t))
    number = F.regexp_extract_all(t, F.lit(f"(?:\\b(?:{PART_WORDS})\\b\\.?\\s*([ivxlcdm]+|{NUMBER_WORDS})\\b)|([0-9]+)"), F.lit(0))
    numbers = F.array_join(F.array_sort(F.transform(number, lambda x: F.regexp_extract(x, "([0-9]+|[ivxlcdm]+|[a-z]+)$", 1))), ",")
    rows = rows.withColumn("numbers", numbers)
    part = f"(?:[\\s,;:.–—-]*[\\(\\[]?\\s*\\b(?:{PART_WORDS})\\b\\.?\\s*(?:[0-9]+|[ivxlcdm]+|{NUMBER_WORDS})\\b\\s*[\\)\\]]?[\\s.]*)"
    rows = step(F.when(F.col("numbers") != "", F.regexp_replace(t, part, " ")).otherwise(t))
    rows = step(F.regexp_replace(t, f"^[^\\p{{L}}\\p{{N}}]*(?:(?:{ARTICLES})\\s+)+(?=\\S)", ""))
    letters = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")
    head = F.regexp_extract(t, "^(.+?)\\s*(?::\\s|\\s[–—-]\\s|;\\s|:$)", 1)
    rows = rows.withColumns({"full": letters(t), "main": F.when(t.rlike("[:;]|\\s[–—-]\\s"), letters(head)).otherwise("")})
    rows = rows.withColumn("has_sub", (F.length("main") > 0) & (F.length("main") < F.length("full")))
    return rows.withColumn("main", F.when(F.col("has_sub"), F.col("main")).otherwise(F.col("full"))).drop("_t")


def _distance_at_most(a: str, b: str, k: int) -> bool:
    """Whether at most k insertions, deletions, replacements or swaps of neighbours part the two."""
    if a == b:
        return True
    start, end = 0, 0
    most = min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    older: list[int] = []
    old = [j if j <= k else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [i if i <= k else far] + [far] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            best = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older[j - 2] + 1)
            new[j] = best
        if min(new) > k:
            return False
        older, old = old, new
    return old[-1] <= k


def _bags(keys: pa.Array) -> np.ndarray:
    """How often the letters of 32 classes occur in each key."""
    cps, starts = code_points(keys)
    row = np.repeat(np.arange(len(keys)), np.diff(starts))
    return np.bincount(row * 32 + cps % 32, minlength=len(keys) * 32).reshape(-1, 32)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose edit distance is at most k. A slip changes the letters of two keys by two at most, so most pairs need no distance."""
    for batch in batches:
        a, b, k = (batch.column(batch.schema.get_field_index(c)) for c in ("key_e", "key_t", "k"))
        batch = batch.take(pa.array(np.flatnonzero(np.abs(_bags(a) - _bags(b)).sum(1) <= 2 * k.to_numpy())))
        a, b, k = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key_e", "key_t", "k"))
        yield batch.filter(pa.array([_distance_at_most(x, y, n) for x, y, n in zip(a, b, k)], pa.bool_()))


def _gram_values(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, key's row and place of every gram of a batch of keys, and the keys' lengths."""
    cps, starts = code_points(keys)
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(cps)) - np.repeat(starts[:-1], size)
    at = np.flatnonzero(place <= size[row] - GRAM) if len(cps) else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        value = (value + cps[at + i].astype(np.uint64) + np.uint64(1)) * MIX
    return value, row[at], place[at], size


def _signatures(keys: pa.Array) -> np.ndarray:
    """A bit for each of 64 classes of letters: whether they occur an odd number of times. A slip turns two bits at most. Keys must not be empty."""
    cps, starts = code_points(keys)
    bits = np.uint64(1) << (((cps.astype(np.uint64) + np.uint64(1)) * MIX) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, starts[:-1]) if len(cps) else np.zeros(0, np.uint64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, row, _, _ = _gram_values(batch.column(0))
        bucket, at = np.unique(value >> BUCKET_SHIFT, return_inverse=True)
        n = [np.bincount(at, weights=batch.column(c).to_numpy(zero_copy_only=False)[row], minlength=len(bucket)).astype(np.int64) for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *map(pa.array, n)], names=["bucket", "n_e", "n_t"])


def _prefixes(counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_e, n_t = counts.value
        for batch in batches:
            value, row, place, size = _gram_values(batch.column(0))
            # One order for all keys: how often the gram's bucket occurs, then the gram, then its place.
            bucket = value >> BUCKET_SHIFT
            order = np.lexsort((place, value, n_e[bucket] + n_t[bucket], row))
            value, row, place, bucket = value[order], row[order], place[order], bucket[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            k = slips(size)
            in_e, in_t = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[row] for c in ("in_e", "in_t"))
            # A gram of the prefix that no key of the other split has meets nothing, so it is not shuffled.
            meets = (in_e & (n_t[bucket] > in_t)) | (in_t & (n_e[bucket] > in_e))
            kept = (rank <= k[row] * (GRAM + 1)) & meets
            row = row[kept]
            rest = batch.select(["kid", "in_e", "in_t"]).take(pa.array(row))
            salts = 1 + n_t[bucket[kept]] // HOT_GRAM
            sign = _signatures(batch.column(0)).view(np.int64)[row]
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(size[row].astype(np.int32)), pa.array(value[kept].view(np.int64)), pa.array(place[kept].astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(sign)],
                names=["kid", "in_e", "in_t", "len", "gram", "pos", "salts", "sign"],
            )

    return run


def slips(length):
    """Slips that keys of so many characters may have: none below 10, one below 24, else two."""
    return np.where(length < 10, 0, np.where(length < 24, 1, 2))


def near_keys(keys: DataFrame) -> DataFrame:
    """key_e, key_t: every evaluation key and training key within the slips allowed, equal ones included.

    ``keys`` has distinct key (string), in_e, in_t (boolean). Empty keys meet nothing. Grams are counted in 2**20 buckets, a table whose size
    does not depend on the data, and each key's rarest ones are picked where the key is; only those that the other split may have
    are shuffled, without their keys but with a signature of their letters that sorts out most candidates where they meet. A gram of many training keys is met by several tasks. Grams that are hashed alike can only
    add candidates, which the edit distance sorts out.
    """
    spark = keys.sparkSession
    own = cut(keys.where(F.length("key") > 0).select("key", "in_e", "in_t", F.xxhash64("key").alias("kid")))
    equal = own.where("in_e and in_t").select(F.col("key").alias("key_e"), F.col("key").alias("key_t"))
    long_ = own.where(F.length("key") >= 10)
    counted = long_.select("key", "in_e", "in_t").mapInArrow(_count_grams, "bucket int, n_e long, n_t long").groupBy("bucket").agg(F.sum("n_e").alias("n_e"), F.sum("n_t").alias("n_t")).toArrow()
    counts = np.zeros((2, 1 << (64 - int(BUCKET_SHIFT))), np.int64)
    counts[:, counted.column("bucket").to_numpy()] = [counted.column(c).to_numpy() for c in ("n_e", "n_t")]
    prefix = cut(long_.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts)), "kid long, in_e boolean, in_t boolean, len int, gram long, pos int, salts int, sign long"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("kid", "len", "pos", "sign")]
    e = prefix.where("in_e").select("gram", *side("e"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    t = prefix.where("in_t").select("gram", *side("t"), F.pmod("kid", "salts").cast("int").alias("salt"))
    k = F.when(F.least("len_e", "len_t") < 24, 1).otherwise(2)  # see slips; shorter keys have no grams here
    alike = F.bit_count(F.col("sign_e").bitwiseXOR(F.col("sign_t"))) <= 2 * k
    pairs = e.join(t, ["gram", "salt"]).where(alike & (F.abs(F.col("len_e") - F.col("len_t")) <= k) & (F.abs(F.col("pos_e") - F.col("pos_t")) <= k) & (F.col("kid_e") != F.col("kid_t")))
    pairs = pairs.select("kid_e", "kid_t", k.alias("k")).distinct()
    pairs = pairs.join(own.where("in_e").select(F.col("kid").alias("kid_e"), F.col("key").alias("key_e")), "kid_e").join(own.where("in_t").select(F.col("kid").alias("kid_t"), F.col("key").alias("key_t")), "kid_t")
    pairs = pairs.select("key_e", "key_t", "k")
    return equal.unionByName(pairs.mapInArrow(_verify, pairs.schema).select("key_e", "key_t"))


def cross_split_overlaps(records: DataFrame) -> DataFrame:
    """id_e, id_t, by ('checksum' or 'title'): pairs of an evaluation and a training record that are the same book.

    ``records`` has id, title, sha256, bytes, split. Records delivered twice count once. A null or unknown split,
    and a null or empty title with no usable checksum, meet nothing.
    """
    own = records.select("id", "title", "split", sha_key(F.col("sha256"), F.col("bytes").cast("long")).alias("sha")).where(F.col("split").isin(*TRAINING, *EVALUATION)).distinct()
    own = own.withColumn("train", F.col("split").isin(*TRAINING))
    sums = own.where(F.col("sha").isNotNull()).select("id", "train", "sha").distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    by_sum = sums.where(~F.col("train")).select(F.col("id").alias("id_e"), "sha", every.alias("salt")).join(sums.where("train").select(F.col("id").alias("id_t"), "sha", salt.alias("salt")), ["sha", "salt"]).select("id_e", "id_t", F.lit("checksum").alias("by"))

    titled = title_parts(own.where(F.col("title").isNotNull()), "title")
    # A record stands under its whole title and, if it has a subtitle, under the title without it. Two that both lack theirs are no pair.
    as_whole = F.struct(F.col("full").alias("key"), F.lit(False).alias("short"))
    as_short = F.struct(F.col("main").alias("key"), F.lit(True).alias("short"))
    stands = titled.select("id", "train", "numbers", "has_sub", F.explode(F.when(F.col("has_sub"), F.array(as_whole, as_short)).otherwise(F.array(as_whole))).alias("s"))
    stands = cut(stands.select("id", "train", "numbers", "has_sub", "s.key", "s.short").where(F.length("key") > 0))
    keys = stands.groupBy("key").agg(F.max(~F.col("train")).alias("in_e"), F.max("train").alias("in_t"))
    near = near_keys(keys)
    every_e = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    e = stands.where(~F.col("train")).select(F.col("id").alias("id_e"), F.col("key").alias("key_e"), F.col("numbers").alias("num_e"), F.col("short").alias("short_e"), F.col("has_sub").alias("sub_e"), salt.alias("salt_e"))
    t = stands.where("train").select(F.col("id").alias("id_t"), F.col("key").alias("key_t"), F.col("numbers").alias("num_t"), F.col("short").alias("short_t"), F.col("has_sub").alias("sub_t"), salt.alias("salt"))
    fit = (F.col("num_e") == F.col("num_t")) & ~(F.col("short_e") & F.col("sub_t")) & ~(F.col("short_t") & F.col("sub_e"))
    by_title = near.withColumn("salt_e", every_e).join(e, ["key_e", "salt_e"]).withColumn("salt", every).join(t, ["key_t", "salt"]).where(fit).select("id_e", "id_t", F.lit("title").alias("by"))
    return by_sum.unionByName(by_title).distinct()


def found_pairs(records: DataFrame) -> DataFrame:
    """ida, idb: the smaller id first."""
    pairs = cross_split_overlaps(records)
    return pairs.select(F.least("id_e", "id_t").alias("ida"), F.greatest("id_e", "id_t").alias("idb")).where("ida <> idb").distinct()


def overlap_report(records: DataFrame) -> DataFrame:
    """Per evaluation split and source: its records, those that overlap training, and the pairs by checksum and by title."""
    pairs = cross_split_overlaps(records)
    own = records.where(F.col("split").isin(*EVALUATION)).select("id", "split", "source").distinct()
    per = pairs.groupBy(F.col("id_e").alias("id")).agg(F.sum((F.col("by") == "checksum").cast("long")).alias("c"), F.sum((F.col("by") == "title").cast("long")).alias("t"))
    return own.join(per, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.count("c").alias("n_overlapping"), F.coalesce(F.sum("c"), F.lit(0)).alias("checksum_pairs"), F.coalesce(F.sum("t"), F.lit(0)).alias("title_pairs")
    )
