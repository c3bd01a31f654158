r"""Fill-in-middle transformation by one regex match per text with counted quantifiers.

`regexp_count` gives the number n of units of a text. Two numbers hashed from the row's key fix the cuts a <= b, and the
pattern of the row is `\A(unit{a}+)(unit{b-a}+)(.*)\z`: its groups are prefix, middle and suffix, and one replacement writes the
groups down in the order of the form. The counted groups are possessive, so the matcher steps through them in a loop: it
neither recurses nor goes back, and a text may have any number of units. Everything is a column expression; no shuffle.

Forms: `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle, each behind its sentinel; `plain` is the text itself.
A text that holds a sentinel stays plain, so a sentinel in the output is always one that was put there, and
`restored` takes the text apart at the sentinels and puts it together again.

Units must tile a text from its beginning to its end, and a unit matched from a place must be the one that a search would
find there; `LINE` and `WORD` do. A pattern that does not match its text stops the query.

Edge cases: null text counts as empty, which is plain; a null key hashes as an empty string; rows that share a key and
have equally many units are cut alike; repeated rows stay; a text of one unit has an empty prefix, middle or suffix; other columns
pass through, those named like a new one are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*\n|[^\n]+"
WORD = r"\s*\S+|\s+\z"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Infill:
    """`rate` and `spm_rate` in per cent: of texts that are transformed, and of those that are written as spm."""

    seed: int = 7
    unit: str = LINE
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def pattern(first: Column, second: Column, unit: str = LINE) -> Column:
    """The regex of a row: `first` units, `second` units and the rest."""
    counted = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"\A"), counted(first), counted(second), F.lit(r"((?s:.*))\z"))


def _written(form: str, how: Infill) -> str:
    """Replacement string: $1, $2 and $3 are prefix, middle and suffix."""
    p, s, m = (x.replace("\\", "\\\\").replace("$", "\\$") for x in how.marks)
    return f"{p}$1{s}$3{m}$2" if form == PSM else f"{s}$3{p}$1{m}$2"


def parts(output: Column, how: Infill = Infill()) -> Column:
    """What stands before, between and behind the sentinels, in the order of the output."""
    return F.split(output, "|".join(map(re.escape, how.marks)))


def _ordered(found: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix; null where the form is plain."""
    psm, spm = form == PSM, form == SPM
    at = lambda i, j: F.when(psm, F.get(found, F.lit(i))).when(spm, F.get(found, F.lit(j)))
    return at(1, 2), at(3, 3), at(2, 1)


def restored(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The text again, from output and form alone."""
    return F.coalesce(F.concat(*_ordered(parts(output, how), form)), output)


def transformed(docs: DataFrame, how: Infill = Infill(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` with n (units), form, output, prefix_chars and middle_chars (code points; null where plain)."""
    if len(set(how.marks)) < 3 or any(a in b for a in how.marks for b in how.marks if a != b) or not all(how.marks):
        raise ValueError("sentinels must be three different strings, none inside another")
    if any(a.startswith(b[k:]) for a in how.marks for b in how.marks for k in range(1, len(b))):
        raise ValueError("the end of a sentinel is the beginning of one")
    h1, h2, h3, h4 = (F.get("_draws", F.lit(k)) for k in range(4))
    count = lambda h: h % (F.col("n") + 1)
    holds = F.lit(False)
    for mark in how.marks:
        holds = holds | F.contains("_text", F.lit(mark))
    form = F.when((F.col("_text") == "") | holds | (h3 % 100 >= how.rate), PLAIN).when(h4 % 100 < how.spm_rate, SPM).otherwise(PSM)
    rows = docs.withColumns({"_text": F.coalesce(F.col(text).cast("string"), F.lit("")), "_draws": F.array(*draws(F.col(key), how.seed))})
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(how.unit)).cast("bigint")).withColumn("form", form)
    rows = rows.withColumn("_pattern", F.when(F.col("form") != PLAIN, pattern(F.least(count(h1), count(h2)), F.abs(count(h1) - count(h2)), how.unit)))
    written = {f: F.regexp_replace("_text", F.col("_pattern"), F.lit(_written(f, how))) for f in (PSM, SPM)}
    rows = rows.withColumn("output", F.when(F.col("form") == PLAIN, F.col("_text")).when(F.col("form") == PSM, written[PSM]).otherwise(written[SPM]))
    rows = rows.withColumn("_parts", F.when(F.col("form") != PLAIN, parts(F.col("output"), how)))
    whole = F.when((F.col("form") == PLAIN) | (F.size("_parts") == 4), F.col("output")).otherwise(F.raise_error(F.lit("units do not tile a text")))
    prefix, middle, _ = _ordered(F.col("_parts"), F.col("form"))
    length = lambda c: F.length(c).cast("bigint")
    return rows.withColumns({"output": whole, "prefix_chars": length(prefix), "middle_chars": length(middle)}).drop("_text", "_draws", "_pattern", "_parts")
