"""CSV records of files that are cut anywhere: many tasks for one file, quoted line breaks kept whole.

Lines are read in splits. Whether a line lies within a quoted value is told by the number of
quotes before it in its file: those of the splits before, one number each, and those before it in its split. The lines of
a split come in order, so a task puts its records together itself; only the two ends of a split that cut a record are shuffled.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.session import stored
from claimloom.sizing import is_small

QUOTE = '"'


def lines(spark, path):
    """(file, split, id, value) of all lines: `split` is where the line's part of the file starts, `id` rises within it."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), F.rtrim("value", F.lit("\r")).alias("value"),
    )


def quotes(value):
    return F.char_length(value) - F.char_length(F.replace(value, F.lit(QUOTE)))


def splits(rows):
    """One row per split: whether it starts within a quoted value, whether any line in it may do so, and its first line."""
    count = quotes(F.col("value"))
    per = rows.groupBy("file", "split").agg(
        F.sum(count).alias("quotes"), F.max(count % 2).alias("odd"), F.min("id").alias("first_id"), F.min_by("value", "id").alias("head"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    whole = Window.partitionBy("file")
    return per.select(
        "file", "split", "first_id", "head", within.alias("within"), (within | (F.col("odd") == 1)).alias("broken"),
        (F.sum("quotes").over(whole) % 2 == 1).alias("unclosed"), (F.col("split") == F.min("split").over(whole)).alias("first"),
    )


def records(spark, path, header=True):
    """(file, value): every record of the CSV files of `path`, without the first of each file if `header`; empty lines are none.

    A quote may stand only in or around a quoted value, doubled within, as CSV asks; a file whose quotes do not close is an
    error, and has to be read whole. Line breaks within a value are kept, `\\r\\n` as `\\n`. Splits are as large as the
    session's `spark.sql.files.maxPartitionBytes` says; where none holds a broken line nothing is shuffled but one row a split.
    Files with different first lines are an error if `header`. An empty file has no records.
    """
    rows = lines(spark, path)
    known = stored(splits(rows), "csv-splits")
    bad = known.filter("unclosed").select("file").head()
    if bad:
        raise ValueError(f"{bad['file']} has an odd number of quotes, so its records cannot be told apart; read it whole")
    heads = known.filter("first").select("head").distinct().take(2) if header else []
    if len(heads) > 1:
        raise ValueError(f"{path} has files with different headers: {heads[0]['head']} and {heads[1]['head']}")
    known_states = known.drop("unclosed", "head")
    small = is_small(known_states)
    placed = rows.join(F.broadcast(known_states) if small else known_states, ["file", "split"])
    is_header = (F.col("first") & (F.col("id") == F.col("first_id"))) if header else F.lit(False)
    simple = placed.filter(~F.col("broken")).filter(~is_header).select("file", "value")
    if known.filter("broken").isEmpty():
        return simple.filter("value != ''")

    # Within a task the lines of a split follow each other in order; a broadcast keeps it.
    opened = placed.filter("broken")
    if not small:
        opened = opened.repartition("file", "split").sortWithinPartitions("file", "split", "id")
    opened = opened.select("file", "split", "value", "within", is_header.alias("header"))
    whole = opened.mapInArrow(_records(ends=False), "file string, value string")
    if known.filter("within").isEmpty():
        return simple.union(whole).filter("value != ''")
    # The ends of splits that cut a record; a record that spans several is numbered by the end that starts it.
    parts = stored(opened.mapInArrow(_records(ends=True), "file string, split long, place int, value string, header boolean"), "csv-parts")
    ahead = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("nth", F.sum((F.col("place") == LAST).cast("long")).over(ahead))
    piece = F.struct("split", "place", "value", "header")
    joined = numbered.groupBy("file", "nth").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    several = joined.filter(~F.exists("parts", lambda x: x["header"])).select("file", text.alias("value"))
    return simple.union(whole).filter("value != ''").union(several)


# Places of a split's ends: lines up to the first that closes a record begun before, and those of a record that goes on.
FIRST, LAST = 0, 1


def _records(ends):
    """Lines of splits in order → the records whole in one split, or the two ends of a split that belong to others.

    A batch holds the lines as they come. What of it is not closed is held until the next batch, so a task holds one batch and one record.
    """
    def run(batches):
        split, inside, held, header, started = None, False, [], False, True

        def end(place):
            return pa.RecordBatch.from_arrays([
                pa.array([split[0]], pa.string()), pa.array([split[1]], pa.int64()), pa.array([place], pa.int32()),
                pa.array(["\n".join(held)], pa.string()), pa.array([header], pa.bool_())], ["file", "split", "place", "value", "header"])

        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column("file"), np.asarray(batch.column("split"))
            odd = np.asarray(pc.count_substring(batch.column("value"), QUOTE)) % 2 == 1
            code = np.asarray(files.dictionary_encode().indices)
            cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (code[1:] != code[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                here = (files[a].as_py(), int(starts[a]))
                if here != split:
                    if ends and split and inside:
                        yield end(LAST if started else FIRST)
                    split, held, header = here, [], False
                    inside = batch.column("within")[a].as_py()
                    started = not inside  # whether the open record began in this split
                after = (np.cumsum(odd[a:b]) + inside) % 2 == 1  # whether a record is open after each line
                closed = np.flatnonzero(~after)
                if not len(closed):
                    held += batch.column("value")[a:b].to_pylist()
                    header = header or batch.column("header")[a].as_py()
                    inside = True
                    continue
                first, last = int(closed[0]), int(closed[-1])
                # The record that was open before these lines, and those that are whole in them.
                held += batch.column("value")[a:a + first + 1].to_pylist()
                header = header or batch.column("header")[a].as_py()
                if started and not ends and not header:
                    yield pa.RecordBatch.from_arrays([pa.array([split[0]], pa.string()), pa.array(["\n".join(held)], pa.string())], ["file", "value"])
                if not started and ends:
                    yield end(FIRST)
                if not ends and len(closed) > 1:
                    values = batch.column("value")[a + first + 1:a + last + 1]
                    bounds = pa.array(np.append(0, closed[1:] - first).astype(np.int32))
                    joined = pc.binary_join(pa.ListArray.from_arrays(bounds, values), "\n")
                    yield pa.RecordBatch.from_arrays([pa.array([split[0]] * len(joined), pa.string()), joined], ["file", "value"])
                held, header, started = batch.column("value")[a + last + 1:b].to_pylist(), False, True
                inside = bool(after[-1])
        if ends and split and inside:
            yield end(LAST if started else FIRST)

    return run
