"""Fill-in-middle transformation by the offsets of a Split pre-tokenizer.

The tokenizers library's Split, with isolated matches of one code point, gives each code point's
offset in the text's UTF-8 bytes; nothing is trained.  The number of offsets is n, and the offsets at two
ranks cut the text into prefix, middle and suffix.  A text is matched in blocks; of a block only
the number of its offsets is kept, and one that holds a rank is matched again.

Where the cuts fall and which form a document takes follows from a hash of its id alone, so
a lost task gives the same rows again.  The form is `plain` (the text as it is) for empty
texts, for texts that hold a sentinel, and for about one document in ten; `spm` puts the suffix
first, `psm` the prefix.  No sentinel can arise where two parts meet, as each begins with `<`
and ends with `>` and has neither inside; so restored() finds the three and gives the exact text.

Null texts count as empty.  A null id hashes as an empty one and stays null.  Every row gives
a row: repeated rows and ids each their own.  Further columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from . import common

#: Sentinels of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents: those that stay plain, and of the others those with the suffix first.
PLAIN, SPM = 10, 20
#: Code points that the pre-tokenizer takes at a time; each is a match of its own, so cuts between calls change nothing.
BLOCK = 128

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


_SPLIT = pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated")


def offsets(block: str) -> list[tuple]:
    """A match for each unit of the block: (text, (start, end) in UTF-8 bytes, None)."""
    matches = PreTokenizedString(block)
    _SPLIT.pre_tokenize(matches)
    return matches.get_splits("original", "byte")


class Units:
    """The units of a whole text: their number n, and where they start in its UTF-8 bytes."""

    def __init__(self, text: str):
        self.text = text
        self.before = list(accumulate((len(offsets(text[at : at + BLOCK])) for at in range(0, len(text), BLOCK)), initial=0))
        self.n = self.before[-1]

    def start(self, rank: int) -> int:
        """Where the unit of this rank starts; for n the end of the text."""
        k = bisect_right(self.before, rank) - 1
        passed, block = self.text[: k * BLOCK], self.text[k * BLOCK : (k + 1) * BLOCK]
        return len(passed.encode()) + (offsets(block)[rank - self.before[k]][1][0] if block and rank < self.n else len(block.encode()))


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed_text(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix, of the middle, output) of one text."""
    units = Units(text)
    n = units.n
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= 100 - PLAIN or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, data = units.start(first), units.start(second), text.encode()
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    if h4 % 100 < SPM:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""

    def run(batches):
        for batch in batches:
            for part in common.slices(iter([batch])):
                ids = part.column(0).to_pylist()
                rows = [transformed_text(i, t or "") for i, t in zip(ids, part.column(1).to_pylist())]
                n, form, prefix, middle, output = zip(*rows)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string())]
                columns += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    named = common.named(docs, doc_id=doc_id, text=text)
    return common.mapped(named.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SCHEMA)


def restored(output: str = "output", form: str = "form"):
    """The column of the texts that gave these outputs."""
    whole = F.col(output)

    def parts(second: str):
        """The three parts in the order in which they stand; the first sentinel is the output's start."""
        body = F.substr(whole, F.lit(len(PREFIX) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    last, first, between = parts(PREFIX)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(first, between, last)).otherwise(whole)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
           n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 AS is_plain,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 AS suffix_first
    FROM texts
), cut AS (
    SELECT *, CASE WHEN is_plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS a, greatest(c1, c2) AS b
    FROM drawn
), parts AS (
    SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN is_plain THEN NULL ELSE a END AS prefix_chars, CASE WHEN is_plain THEN NULL ELSE b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
