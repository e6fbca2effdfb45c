"""A stored index: records, vectors and an inverted index in blocks with bounds, grown by runs that hold changed documents alone.

    root/records, vectors   run=R/: the rows of the documents that run R wrote
    root/postings           run=R/part=P/: term, range, n, most, least, postings (id, tf, dl); a row is a block
    root/terms              run=R/part=P/: term, df: by how much the run changed it
    root/manifest           run=R/: doc_id, digest, alive: the documents that the run wrote or took away
    root/stale              run=R/: of, id: records of earlier runs that no longer count
    root/commits            R.json, written last: a run without it doesn't exist for readers

part is a term's hash, so that a search reads the folders of its terms. range is a record's: its text's length class and its id's hash. Within a range lengths differ by
a factor of two at most, and so a block's largest tf (most) and smallest length (least) bound the score of its records closely."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import RetrievalConfig, raw_idf, top_k
from ..session import Tables

#: Records of a range, about; bytes of text for each folder of terms, and the fewest and most of these; runs after which an update writes everything anew.
RANGE_RECORDS, PART_BYTES, PARTS, MOST_RUNS = 512, 256 << 20, (8, 4096), 32
#: Ranges of a query that are scored first; their k-th best score closes all ranges that can't reach it.
PROBES = 4
#: Terms up to which a search names its terms to the scan, which then skips other folders and row groups.
NAMED_TERMS = 256
#: Pairs of a query and a record that a task of a search scores, about; pairs of a query and a range up to which all tasks are told which are open.
SCORED_PAIRS, OPEN_PAIRS = 1 << 20, 200_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, root: str) -> list[dict]:
    """The committed runs that count: from the last one that holds everything on, in order."""
    fs, p = _fs(spark, f"{root}/commits")
    if not fs.exists(p):
        return []
    found = []
    for f in fs.listStatus(p):  # small files, one for each run
        if f.getPath().getName().endswith(".json"):
            stream = fs.open(f.getPath())
            try:
                found.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    found.sort(key=lambda c: c["run"])
    return found[max((i for i, c in enumerate(found) if c["base"]), default=0) :]


def commit(spark: SparkSession, root: str, entry: dict) -> None:
    fs, p = _fs(spark, f"{root}/commits/{entry['run']:06d}.json")
    out = fs.create(p, False)  # of two writers of one run the second fails
    try:
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    finally:
        out.close()


def length_class(text: Column) -> Column:
    return F.floor(F.log2(F.octet_length(text) + F.lit(1))).cast("int")


def range_of(id_col: Column, text: Column, ranges: dict[str, int]) -> Column:
    """A record's range. ranges: how many each length class has, by its number; a class that is not there has one."""
    n = F.lit(1)
    if ranges:
        table = F.create_map(*(F.lit(x) for k, v in ranges.items() for x in (int(k), v)))
        n = F.coalesce(F.try_element_at(table, length_class(text)), F.lit(1))
    return length_class(text).cast("long") * (1 << 40) + F.pmod(F.xxhash64(id_col), n.cast("long"))


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def blocks(records: DataFrame, ranges: dict[str, int], parts: int) -> DataFrame:
    """term, range, n, most, least, postings, part of records (id, text, tokens).

    Records move once, to their range; terms are counted and gathered there, so that neither single words nor single postings are shuffled. A block has at most a range's records."""
    held = records.select("id", "tokens", range_of(F.col("id"), F.col("text"), ranges).alias("range")).repartition("range")
    each = held.select("range", "id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    counted = each.groupBy("range", "id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    rows = counted.groupBy("range", "term").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.collect_list(F.struct("id", "tf", "dl")).alias("postings"))
    return rows.select("term", "range", "n", "most", "least", "postings", part_of(F.col("term"), parts).alias("part"))


@dataclass(frozen=True)
class Index:
    """A committed state of an index at root."""

    spark: SparkSession
    root: str
    runs: list[dict] = field(repr=False)

    @property
    def last(self) -> dict:
        return self.runs[-1]

    @property
    def n(self) -> int:
        return self.last["n"]

    @property
    def avgdl(self) -> float:
        return self.last["length"] / self.last["n"] if self.last["n"] else 0.0

    def table(self, name: str) -> DataFrame:
        """All rows of the runs that count; only their folders are read."""
        paths = [f"{self.root}/{name}/run={c['run']}" for c in self.runs if name in c["tables"]]
        if not paths:
            raise FileNotFoundError(f"no {name} at {self.root}")
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def has(self, name: str) -> bool:
        return any(name in c["tables"] for c in self.runs)

    def live(self, name: str) -> DataFrame:
        """Rows of records or vectors (run, id, ...) that still count."""
        rows = self.table(name)
        if self.has("stale"):
            gone = self.table("stale").select(F.col("of").alias("run"), "id").distinct()
            rows = rows.join(gone, ["run", "id"], "left_anti")
        return rows

    def records(self) -> DataFrame:
        return self.live("records").drop("run")

    def vectors(self) -> DataFrame:
        return self.live("vectors").drop("run")

    def documents(self) -> DataFrame:
        """doc_id, digest, run of the documents there are: each as its last run has it."""
        rows = self.table("manifest").groupBy("doc_id").agg(F.max_by(F.struct("digest", "alive", "run"), "run").alias("m"))
        return rows.where("m.alive").select("doc_id", "m.digest", "m.run")

    def frequencies(self) -> DataFrame:
        """part, term, df of all terms that a record has."""
        rows = self.table("terms")
        return rows.select("part", "term", "df") if len(self.runs) == 1 else rows.groupBy("part", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def weighted(self, frequencies: DataFrame, epsilon: float) -> DataFrame:
        """frequencies with idf; a negative one becomes epsilon times the mean of all terms, which the last run has stored."""
        raw = raw_idf(F.lit(self.n), F.col("df"))
        return frequencies.withColumn("idf", F.when(raw < 0, F.lit(epsilon * self.last["mean_idf"])).otherwise(raw))

    def term_weights(self, epsilon: float = 0.25) -> DataFrame:
        """term, df, idf of the whole vocabulary."""
        return self.weighted(self.frequencies(), epsilon).select("term", "df", "idf")

    def named(self, table: DataFrame, terms: DataFrame) -> DataFrame:
        """table cut to the folders and terms of `terms` (one column), where these are few enough to be named to the scan."""
        first = [r[0] for r in terms.distinct().limit(NAMED_TERMS + 1).collect()]
        if len(first) > NAMED_TERMS:
            return table
        parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in first], "term string").select(part_of(F.col("term"), self.last["parts"])).distinct().collect()]
        return table.where(F.col("part").isin(parts) & F.col("term").isin(first))

    def asked(self, queries: DataFrame, epsilon: float) -> DataFrame:
        """query_id, part, term, qf, idf of queries (query_id, tokens); terms that no record has go."""
        each = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        each = each.withColumn("part", part_of(F.col("term"), self.last["parts"]))
        found = self.named(self.frequencies(), each.select("term"))
        return self.weighted(each.join(found, ["part", "term"]), epsilon).drop("df")

    def postings(self, of: DataFrame) -> DataFrame:
        """The blocks `of` (run, postings, ...) opened: a row for each of their records that still count, with id, tf and dl."""
        rows = of.select("*", F.inline("postings")).drop("postings")
        return rows.join(self.table("stale").select(F.col("of").alias("run"), "id").distinct(), ["run", "id"], "left_anti") if self.has("stale") else rows

    def search(self, queries: DataFrame, k: int, config: RetrievalConfig = RetrievalConfig(), order_col: str = "id") -> DataFrame:
        """query_id, id, score, dl, rank: what retrieval.bm25 finds, with the records' lengths, from the index alone.

        A query's ranges are bounded by the sums of their blocks' bounds. The PROBES ranges of the largest bounds are scored first; of the rest only
        those are opened whose bound reaches the k-th score found. The result is that of scoring everything."""
        put = Tables(self.spark).put
        asked = put(self.asked(queries, config.epsilon), "asked")
        terms = put(asked.select("part", "term").distinct(), "asked_terms")
        held = self.named(self.table("postings"), terms.select("term")).join(terms, ["part", "term"], "left_semi")
        tasks = max(1, -(-self.n * asked.select("query_id").distinct().count() // SCORED_PAIRS))

        def part_score(tf: Column, dl: Column) -> Column:
            return F.col("qf") * F.col("idf") * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * dl / F.lit(self.avgdl or 1.0)))

        bound = F.greatest(part_score(F.col("most"), F.col("least")), F.lit(0.0))
        found = held.select("run", "part", "term", "range", "most", "least").join(asked, ["part", "term"])
        found = found.select("query_id", "range", "term", bound.alias("bound"))
        if len(self.runs) > 1:  # a record stands in one run's block
            found = found.groupBy("query_id", "range", "term").agg(F.max("bound").alias("bound"))
        bounds = put(found.groupBy("query_id", "range").agg(F.sum("bound").alias("bound")), "bounds")

        def scored(ranges: DataFrame, name: str) -> DataFrame:
            """The records of open ranges. Blocks of asked terms move once, to their range, where their records are scored: no pair of a query and a record is shuffled."""
            ranges = put(ranges.select("query_id", "range"), name)
            rows = held.drop("n", "most", "least").join(put(ranges.select("range").distinct(), f"{name}_ranges"), "range", "left_semi")
            rows = rows.repartition(tasks, "range").join(asked, ["part", "term"])
            if ranges.count() <= OPEN_PAIRS:  # beyond, what an open range holds is scored for all queries, which changes no hit
                rows = rows.join(F.broadcast(ranges), ["query_id", "range"], "left_semi")
            return self.postings(rows).groupBy("range", "query_id", "id").agg(F.sum(part_score(F.col("tf"), F.col("dl"))).alias("score"), F.first("dl").alias("dl")).drop("range")

        first = scored(top_k(bounds, ["query_id"], [F.desc("bound"), F.col("range")], PROBES), "probed")
        least = top_k(first.where("score > 0"), ["query_id"], [F.desc("score")], k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("many"))
        least = put(least.where(F.col("many") >= k).select("query_id", "least"), "least")
        # scores are ordered by nine places, so that a bound has to miss by more than that
        opened = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8))
        found = top_k(scored(opened, "opened"), ["query_id"], [F.desc(F.round("score", 9)), F.col(order_col)], k).where("score > 0")
        # hits are few and read more than once; written, they are also free of a partitioning that a union with another leg would have to match
        return put(found.select("query_id", "id", "score", "dl", "rank"), "hits")

    def holds(self, wanted: DataFrame, hits: DataFrame) -> DataFrame:
        """query_id, rank, term: which wanted terms (query_id, term, token) the hits (query_id, id, rank) have, by their postings alone; a term counts with any of its tokens."""
        wanted = wanted.withColumn("part", part_of(F.col("token"), self.last["parts"])).withColumnRenamed("term", "wanted").withColumnRenamed("token", "term")
        rows = self.table("postings").drop("n", "most", "least")
        rows = self.named(rows, wanted.select("term")).join(wanted, ["part", "term"])
        rows = rows.join(hits.select("query_id", F.col("id").alias("hit"), "rank"), "query_id").where(F.exists("postings", lambda p: p["id"] == F.col("hit")))
        if self.has("stale"):
            rows = rows.join(self.table("stale").select(F.col("of").alias("run"), F.col("id").alias("hit")).distinct(), ["run", "hit"], "left_anti")
        return rows.select("query_id", "rank", F.col("wanted").alias("term")).distinct()


def open_index(spark: SparkSession, root: str, **wanted) -> Index:
    """The index at root. One that isn't there, or was built with other settings than those wanted (such as the embedder's name and dimension), is an error."""
    runs = commits(spark, root)
    if not runs:
        raise FileNotFoundError(f"no index at {root}")
    for k, v in wanted.items():
        if runs[-1]["settings"].get(k) != v:
            raise ValueError(f"the index at {root} has {k} {runs[-1]['settings'].get(k)!r}, {v!r} is wanted: build it anew")
    return Index(spark, root, runs)


def digests(records: DataFrame) -> DataFrame:
    """doc_id, digest: changes with any id or text of a document's records. Sums, so that a document of any number of records is a row for each task."""
    sums = [F.sum(F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("text")).cast("decimal(38,0)")) for seed in (1, 2)]
    return records.groupBy("doc_id").agg(F.concat_ws("-", F.count(F.lit(1)), *sums).alias("digest"))


def update_index(records: DataFrame, root: str, settings: dict | None = None, vectors=None, force: bool = False, whole: bool = True) -> str:
    """Brings the index at root to the state of records (id, doc_id, text, tokens, ...), and returns built, updated or skipped.

    Only documents whose ids or texts changed are written; documents that records lack are taken away if records are the whole corpus (whole). vectors: a
    function from changed records to id, v. A first run, other settings, force, MOST_RUNS runs, or more stale records than live ones write everything anew. Ids
    are unique over the corpus; a repeated one is an error. No records at all for a new index is an error. A run that fails leaves the index as it was; two writers at a time are not both served."""
    spark, settings = records.sparkSession, settings or {}
    put, runs = Tables(spark).put, commits(spark, root)
    number = runs[-1]["run"] + 1 if runs else 0
    old = Index(spark, root, runs) if runs else None
    base = force or old is None or old.last["settings"] != settings or len(runs) >= MOST_RUNS
    if base and old is not None and not whole:  # the documents that records don't speak of are written anew with them
        records = put(old.records().join(records.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(records), "all")
    fresh = put(digests(records), "digests")
    if base:
        changed, gone = fresh, None
        if fresh.limit(1).count() == 0:
            raise ValueError("no chunk is long enough to index")
    else:
        have = old.documents()
        changed = put(fresh.join(have.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti"), "changed")
        lost = have.join(fresh.select("doc_id", F.col("digest").alias("now")), "doc_id", "left")
        gone = put(lost.where((F.col("now") != F.col("digest")) | (F.col("now").isNull() if whole else F.lit(False))).select("doc_id", "run", F.col("now").isNotNull().alias("again")), "gone")
        if changed.limit(1).count() == 0 and gone.limit(1).count() == 0:
            return "skipped"
    mine = records if base else records.join(changed.select("doc_id"), "doc_id", "left_semi")
    return _write(spark, root, number, mine, changed, gone, old, base, settings, vectors, put) or update_index(records, root, settings, vectors, True, whole)


def _write(spark, root, number, records, changed, gone, old, base, settings, vectors, put) -> str | None:
    """Writes a run and commits it. None if the run would leave more stale records than live ones."""

    tables = []

    def save(df: DataFrame, name: str) -> DataFrame:
        """Writes a table of the run; one without rows is left out of those that the run has."""
        path = f"{root}/{name}/run={number}"
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy("part") if "part" in df.columns else w).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        if base or out.limit(1).count():  # a run that writes everything has rows in each of its tables
            tables.append(name)
        return out

    mine = save(records, "records")
    by_class = mine.groupBy(length_class(F.col("text")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("length"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    n, length = sum(r["n"] for r in by_class), sum(r["length"] for r in by_class)
    if mine.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id repeats")
    if base:
        ranges = {str(r["c"]): -(-r["n"] // RANGE_RECORDS) for r in by_class if r["c"] is not None}
        parts = min(max(PARTS[0], -(-sum(r["bytes"] or 0 for r in by_class) // PART_BYTES)), PARTS[1])
    else:
        ranges, parts = old.last["ranges"], old.last["parts"]
    # each task of ranges writes its part of a folder, so that blocks aren't shuffled again
    plus = save(blocks(mine, ranges, parts).sortWithinPartitions("part", "term", "range"), "postings")
    terms = plus.groupBy("part", "term").agg(F.sum("n").alias("df"))
    stale = 0
    if gone is not None:
        was = put(old.live("records").join(gone.select("doc_id", "run"), ["doc_id", "run"], "left_semi").select("run", "id", "tokens"), "was")
        lost = was.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("length")).first()
        n, length, stale = old.n + n - lost["n"], old.last["length"] + length - lost["length"], old.last["stale"] + lost["n"]
        if stale > n > 0:
            return None
        minus = was.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        terms = terms.unionByName(minus.withColumn("part", part_of(F.col("term"), parts))).groupBy("part", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        save(was.select(F.col("run").alias("of"), "id"), "stale")
    save(terms.repartition("part").sortWithinPartitions("part", "term"), "terms")
    rows = changed.withColumn("alive", F.lit(True))
    if gone is not None:
        rows = rows.unionByName(gone.where("not again").select("doc_id", F.lit("").alias("digest"), F.lit(False).alias("alive")))
    save(rows, "manifest")
    if vectors is not None:
        save(vectors(mine), "vectors")
    entry = {"run": number, "base": base, "tables": tables, "settings": settings, "n": n, "length": length, "stale": stale, "ranges": ranges, "parts": parts, "mean_idf": 0.0}
    state = Index(spark, root, [*([] if base else old.runs), entry])
    mean = state.frequencies().agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]
    commit(spark, root, {**entry, "mean_idf": mean or 0.0})
    return "built" if base else "updated"
