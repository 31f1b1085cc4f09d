"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text are hashed; a window that occurs anywhere earlier, by
(id, line number), is a repeat, and the lines that repeats cover go.  Covered positions are merged
into runs, so a passage of any length from three lines on goes as one piece.

DataFrame functions only.  Windows travel as hashes (96 bits), never as text.  The first place of
each window comes from an aggregate with map-side combine, so a window found in a third of all
documents is one row a task; the join back to the places is left to adaptive execution, which
splits skewed partitions.

Cases: a null text stays null and has no lines; texts of fewer than three lines are left as they
are; a very long text is one row whose lines are in memory at once; windows of lines that are empty or of spaces (0x20)
only are no windows, while a carriage return or tab is content, so blank lines of CRLF files count as lines like any
other; a line keeps its carriage return; a null id comes before all others; rows that share id and text are one document and
fare alike; an empty table gives an empty result; other columns are carried, those named like the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_names

WINDOW = 3


def _let(value, body):
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with `text` cleaned, and two counts added, named by `names`; columns of docs with these names are replaced."""
    docs = docs.drop(*names)
    lines = F.split(F.col(text), "\n")
    runs_, hash_, clash, t_, lines_, gone_, cleaned_ = free_names([*docs.columns, *names], "__runs", "__h", "__key", "__t", "__n_lines", "__gone", "__cleaned")

    def windows(parts):
        one = F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) == "").alias("blank")))

        def at(h, i):
            near = [F.get(h, i + j) for j in range(WINDOW)]
            return F.struct(i.alias("pos"), F.xxhash64(*[x["a"] for x in near]).alias("a"), F.hash(*[x["b"] for x in near]).alias("b"), (near[0]["blank"] & near[1]["blank"] & near[2]["blank"]).alias("blank"))

        return _let(one, lambda h: F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: at(h, i)), lambda w: ~w["blank"]))

    places = docs.filter(F.col(text).isNotNull() & (F.size(lines) >= WINDOW)).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.explode(windows(lines)).alias("w")).select("k", "t", "w.pos", "w.a", "w.b")
    place = F.struct("k", "t", "pos")
    first = places.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("a", "b", "first")
    # kept, so that the join has plain exchanges on both sides and a hot window's places can be split
    later = places.join(checkpointed(first), ["a", "b"]).filter(place > F.col("first")).select("k", "t", "pos")
    by_doc = Window.partitionBy("k", "t").orderBy("pos")
    later = later.withColumn("run", F.sum(F.when(F.col("pos") - F.lag("pos").over(by_doc) <= WINDOW, 0).otherwise(1)).over(by_doc))
    runs = later.groupBy("k", "t", "run").agg(F.min("pos").alias("start"), (F.max("pos") + WINDOW).alias("end"))
    runs = runs.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(runs_)).select(F.col("k").alias(clash), F.col("t").alias(t_), runs_)
    found = docs.withColumn(hash_, F.xxhash64(text))
    found = found.join(runs, found[key].eqNullSafe(runs[clash]) & (found[hash_] == runs[t_]), "left")

    def kept(parts):
        n, r = F.size(parts), F.col(runs_)
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(r, k - 1)["end"])
        stop = lambda k: F.when(k == F.size(r), n).otherwise(F.get(r, k)["start"])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(r)), lambda k: F.slice(parts, begin(k) + 1, stop(k) - begin(k))))

    cleaned = F.when(F.col(runs_).isNull(), F.col(text)).otherwise(F.array_join(_let(lines, kept), "\n"))
    gone = F.coalesce(F.aggregate(runs_, F.lit(0), lambda n, r: n + r["end"] - r["start"]), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = found.withColumn(lines_, n_lines).withColumn(gone_, gone).withColumn(cleaned_, cleaned)
    return out.select(*[F.col(cleaned_).alias(text) if c == text else F.col(c) for c in docs.columns], F.col(lines_).alias(names[0]), F.col(gone_).alias(names[1]))
