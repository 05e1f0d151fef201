"""Line dedup: winnowed line fingerprints, joined by position and extended to whole repeated runs."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import stage
from .base import join_by_weight, map_records, query, table

# lines of a run that is looked for, and of the window whose smallest hash is a fingerprint
RUN_LINES = 3
# words from which a run of fewer lines is looked for too
RUN_WORDS = 50
# runs that are broadcast at most, 8 bytes each
BROADCAST_STARTS = 5_000_000
# White space that does not count at the ends of a line
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: str) -> list[tuple[int, str]]:
    """Number and stripped text of every line that is not blank."""
    return [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(BLANKS))]


def _fingerprints(docs: DataFrame, size: int, words: int | None) -> DataFrame:
    """A row per fingerprint: its hash, place, the lines of a window, the first window it stands for and the hashes of these windows.

    Every window of `size` lines selects its leftmost smallest line hash, so two
    equal windows select the same line, and any run of `size` lines that occurs
    twice has a fingerprint in common. A run of fewer lines and at least `words`
    words is a window and a fingerprint of its own.
    """

    def run(rows):
        for doc, version, text in rows:
            lines = [s.encode() for _, s in lines_of(text)]
            digests = [xxhash.xxh128_digest(s) for s in lines]
            if words is not None:
                before = [0, *accumulate(len(s.split()) for s in lines)]
                for n in range(1, size):
                    for a in range(len(lines) - n + 1):
                        if before[a + n] - before[a] >= words:
                            one, two = np.frombuffer(xxhash.xxh128_digest(b"".join(digests[a : a + n])), "<i8").tolist()
                            yield one, doc, version, n, a, [one], [two]
            if len(lines) < size:
                continue
            hashes = np.frombuffer(b"".join(digests), "<u8")[::2]
            views = np.lib.stride_tricks.sliding_window_view(hashes, size)
            places = views.argmin(axis=1) + np.arange(len(views))
            border = np.append(0, np.flatnonzero(np.diff(places)) + 1)
            for a, b in zip(border.tolist(), [*border[1:].tolist(), len(places)]):
                both = [np.frombuffer(xxhash.xxh128_digest(b"".join(digests[s : s + size])), "<i8") for s in range(a, b)]
                yield int(hashes[places[a]].astype(np.int64)), doc, version, size, a, [int(x[0]) for x in both], [int(x[1]) for x in both]

    return map_records(docs.select("doc", "version", "text"), run, "print bigint, doc bigint, version bigint, n int, start int, one array<bigint>, two array<bigint>")


def repeated_runs(docs: DataFrame, size: int, words: int | None = RUN_WORDS) -> DataFrame:
    """doc, version, runs (array of start and n, in lines that are not blank) of windows that an earlier place has too."""
    place = F.struct("doc", "version", "start")
    prints = stage(_fingerprints(docs, size, words))
    shared = prints.groupBy("print").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("rows")).where(F.col("lo") < F.col("hi")).select("print", "rows")
    # a line that a third of all documents have is one fingerprint: hot ones meet their row where they are
    met = join_by_weight(prints, stage(shared), "print", "rows", prints.count(), "inner")
    # extension both ways: the windows around a shared fingerprint, each against its earliest place
    met = met.select("doc", "version", "n", F.col("start").alias("from"), F.posexplode(F.arrays_zip("one", "two")).alias("i", "w"))
    met = met.select("doc", "version", "n", (F.col("from") + F.col("i")).alias("start"), "w.one", "w.two")
    met = stage(met)
    first = met.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    later = join_by_weight(met, stage(first), ["one", "two"], "rows", met.count(), "inner").where(F.col("first") < place)
    return later.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))


def remove_runs(docs: DataFrame, size: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", words: int | None = RUN_WORDS) -> DataFrame:
    """Every row of `docs`, with `text_col` less its later repeated runs, n_lines, n_removed (lines that are not blank).

    A run of `size` or more lines, or of fewer that have at least `words` words
    together (white space at line ends and blank lines aside; words None: no
    such runs), is repeated when the same lines stand in the same order at an
    earlier place: a smaller id, or the same id and further up. All lines of later runs
    go; other lines, blank ones too, stay as they are. Of different texts with
    one id, that with the smaller hash is earlier; rows equal in id and text are
    not earlier than each other. Rows without an id are neither changed nor
    looked at, a null text stays null. Other columns stay, but for older ones named n_lines or n_removed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.withColumn("__doc", F.col(id_col).cast("bigint")).withColumn("__version", F.xxhash64(text))
    rows = whole.where(F.col("__doc").isNotNull()).select(F.col("__doc").alias("doc"), F.col("__version").alias("version"), text.alias("text"))
    found = stage(repeated_runs(rows, size, words))
    small = (found.agg(F.sum(F.size("runs") + 8)).collect()[0][0] or 0) <= BROADCAST_STARTS
    found = found.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("runs").alias("__runs"))
    joined = whole.join(F.broadcast(found) if small else found, ["__doc", "__version"], "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    at = names.index(text_col)

    def run(parts):
        for *row, runs in parts:
            text = row[at]
            lines = lines_of(text) if text else []
            gone: set[int] = set()
            for r in runs or ():
                gone.update(i for i, _ in lines[r["start"] : r["start"] + r["n"]])
            if gone:
                row[at] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            yield (*row, len(lines), len(gone))

    kind = StructType([*[docs.schema[c] for c in names], StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return map_records(joined.select(*[F.col(f"`{c}`") for c in names], "__runs"), run, kind)


_TRIM = "trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13)))"
SQL = rf"""WITH l AS (SELECT doc_id, i, list_extract(v, CAST(i AS BIGINT)) AS x FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS v FROM documents))),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, {_TRIM} AS s FROM l WHERE {_TRIM} <> ''),
v AS (SELECT *, len(list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS nw FROM n),
w AS (SELECT *, lead(s, 1) OVER o AS s2, lead(s, 2) OVER o AS s3, lead(nw, 1) OVER o AS nw2 FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, k, 3 AS n, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, k) AS r FROM w WHERE s3 IS NOT NULL
  UNION ALL SELECT doc_id, k, 2, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, k) FROM w WHERE s2 IS NOT NULL AND nw + nw2 >= {RUN_WORDS}
  UNION ALL SELECT doc_id, k, 1, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) FROM w WHERE nw >= {RUN_WORDS}),
g AS (SELECT DISTINCT doc_id, k + j AS k FROM f, (SELECT unnest([0, 1, 2]) AS j) WHERE r > 1 AND j < n),
m AS (SELECT l.doc_id, l.i, l.x, n.k IS NOT NULL AS line, g.k IS NOT NULL AS gone FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.i = l.i LEFT JOIN g ON g.doc_id = n.doc_id AND g.k = n.k)
SELECT doc_id, CAST(count(*) FILTER (WHERE line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stand at an earlier place, of three lines or of RUN_WORDS words."""
    out = remove_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
