"""An index of the keys of a table that grows without bound, of which a batch reads only its buckets.

The index lies in a folder beside the table. Its rows are keys in folders by the first bits of their digest; the
number of bits follows the number of keys, so a bucket stays within a bound however large the
table. It knows which files of the table it holds, and takes in those that were committed since before it is asked: a
crash between the two leaves nothing out, and a file that is taken in twice changes nothing. A new generation,
with more or with fewer and larger files, is written whole before the last one is given up.
"""

from pyspark.sql import functions as F

#: Keys of a bucket on average, before the number of buckets is doubled; least and most bits of a bucket's number.
PER_BUCKET = 100_000
LEAST_BITS, MOST_BITS = 4, 16
#: Additions to a generation before its files are rewritten as one a bucket.
ADDITIONS = 32
#: Buckets that are named in the filter of a read; a batch that hits more reads all.
NAMED_BUCKETS = 5_000


def bucket(key, bits):
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


class KeyIndex:
    """The keys in column `key` of the Parquet table at `table`."""

    def __init__(self, spark, table, key):
        self.spark, self.table, self.key = spark, table, key
        self.path = table.rstrip("/") + "-keys"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def generations(self):
        """(number, bits) of the generations that are whole, the latest last."""
        if not self.files.exists(self._hadoop(self.path)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self._hadoop(self.path))]
        whole = [n for n in names if self.files.exists(self._hadoop(f"{self.path}/{n}/held/_SUCCESS"))]
        return sorted(tuple(map(int, n.removeprefix("gen-").split("-"))) for n in whole)

    def _folder(self, generation, part):
        return f"{self.path}/gen-{generation[0]}-{generation[1]}/{part}"

    def _held(self, generation):
        return self.spark.read.schema("file string, keys long, addition long").parquet(self._folder(generation, "held"))

    def keys(self, generation):
        return self.spark.read.schema(f"`{self.key}` string, bucket int").parquet(self._folder(generation, "keys"))

    def _write(self, rows, generation):
        rows = rows.select(self.key, bucket(self.key, generation[1]).alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._folder(generation, "keys"))

    def refresh(self):
        """Takes in the table's files that are not held yet; returns the latest generation."""
        found = self.spark.read.schema(f"`{self.key}` string").parquet(self.table).inputFiles()
        generations = self.generations()
        now = generations[-1] if generations else (0, LEAST_BITS)
        held = self._held(now).collect() if generations else []  # one row a file, as in the listing above
        new = sorted(set(found) - {r["file"] for r in held})
        if new or not held:
            rows = self.spark.read.schema(f"`{self.key}` string").parquet(*new).filter(F.col(self.key).isNotNull()) if new else None
            count = rows.count() if new else 0
            if new:
                self._write(rows, now)
            addition = 1 + max((r["addition"] for r in held), default=0)
            names = [(f, count if i == 0 else 0, addition) for i, f in enumerate(new)]
            marks = self.spark.createDataFrame(names, "file string, keys long, addition long").coalesce(1)
            marks.write.mode("append").parquet(self._folder(now, "held"))
            total = count + sum(r["keys"] for r in held)
            bits = now[1]
            while total > PER_BUCKET << bits and bits < MOST_BITS:
                bits += 1
            if bits > now[1] or addition >= ADDITIONS:
                now = self._rewrite(now, (now[0] + 1, bits))
        return now

    def _rewrite(self, old, new):
        """The generation `new` with each key once and one file a bucket, and the end of `old`."""
        rows = self.keys(old).select(self.key).distinct()
        self._write(rows, new)
        held = self._held(old).select("file", "keys", F.lit(0).cast("long").alias("addition"))
        held.coalesce(1).write.mode("append").parquet(self._folder(new, "held"))
        self.files.delete(self._hadoop(f"{self.path}/gen-{old[0]}-{old[1]}"), True)
        return new

    def known_near(self, batch):
        """The indexed keys of the buckets that keys of `batch` lie in, one column."""
        now = self.refresh()
        if not self.files.exists(self._hadoop(self._folder(now, "keys"))):
            return self.spark.createDataFrame([], f"`{self.key}` string")
        hits = batch.select(bucket(self.key, now[1]).alias("bucket")).distinct().limit(NAMED_BUCKETS + 1).collect()
        rows = self.keys(now)
        if len(hits) <= NAMED_BUCKETS:
            rows = rows.filter(F.col("bucket").isin([r["bucket"] for r in hits if r["bucket"] is not None]))
        return rows.select(self.key)
