"""Fill-in-middle transformation: texts are cut into units by a zero-width regular expression and their parts rearranged.

A unit grammar says between which neighbouring characters one unit ends and the next begins. It becomes a look-behind
for the one class and a look-ahead for the other, so ``split`` consumes nothing and the pieces joined are the text.
The empty text has no unit; ``split`` would give one empty piece, so it is told apart. Only SQL functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import fresh, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Grammar:
    """A unit ends behind a character of class ``last`` that is followed by one of class ``first``; or as in ``also``."""

    last: str
    first: str
    also: Grammar | None = None

    def boundary(self) -> str:
        own = f"(?<={self.last})(?={self.first})"
        return f"{own}|{self.also.boundary()}" if self.also else own


ANY = r"[\s\S]"
#: ``[^\n]*\n|[^\n]+``
LINES = Grammar(r"\n", ANY)
#: Words with the white space behind them; white space at the start of a text is a unit.
WORDS = Grammar(r"\s", r"\S")
#: Runs of white space and runs of other characters.
RUNS = Grammar(r"\s", r"\S", Grammar(r"\S", r"\s"))
#: Sentences with the white space behind them: a stop, white space, and no more of it.
SENTENCES = Grammar(r"[.!?。]\s", r"\S")
CHARACTERS = Grammar(ANY, ANY)


def units(text: Column, grammar: Grammar = LINES) -> Column:
    """The units of a text, which joined are the text; none for the empty text, null for null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def _draws(key: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from a key, the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def rearranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar = LINES, rate: int = 100, spm_share: int = 50, seed: int = 7, name: str = "fim") -> DataFrame:
    """``docs`` with a struct ``name``: n, form, output, prefix_chars and middle_chars.

    Of ``n`` units the two cuts are drawn by the id, each of the n + 1 places alike. ``rate`` percent of the texts are
    rearranged, ``spm_share`` percent of those suffix first; texts that are empty or hold a marker stay plain. The
    character counts are null for plain ones. A null text is empty; a null id draws by the seed alone; repeated ids
    draw alike. All columns stay; ``name`` must be one that they don't have in any letter case (as ``fresh`` gives).
    A text is one row whatever its length.
    """
    text = text_of(F.col(text_col).cast("string"))
    inner, t, u, h, n, a, b = (fresh(docs, x) for x in ("_row", "_t", "_u", "_h", "_n", "_a", "_b"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    cut = docs.select(F.struct(*docs.columns).alias(inner), text.alias(t), _draws(key, seed).alias(h)).withColumn(u, units(F.col(t), grammar)).withColumn(n, F.size(u).cast("bigint"))
    one, two = (F.col(h)[i] % (F.col(n) + 1) for i in (0, 1))
    placed = cut.withColumns({a: F.least(one, two).cast("int"), b: F.greatest(one, two).cast("int")})
    marked = F.contains(F.col(t), F.lit(PREFIX)) | F.contains(F.col(t), F.lit(SUFFIX)) | F.contains(F.col(t), F.lit(MIDDLE))
    form = F.when((F.col(t) == "") | marked | (F.col(h)[2] % 100 >= rate), PLAIN).when(F.col(h)[3] % 100 < spm_share, SPM).otherwise(PSM)
    part = lambda lo, many: F.array_join(F.slice(u, lo + 1, many), "")
    parts = F.struct(part(F.lit(0), F.col(a)).alias("prefix"), part(F.col(a), F.col(b) - F.col(a)).alias("middle"), part(F.col(b), F.col(n).cast("int") - F.col(b)).alias("suffix"))
    p = fresh(docs, "_p")
    formed = placed.select(inner, t, n, form.alias(name), parts.alias(p))
    f, prefix, middle, suffix = F.col(name), F.col(f"{p}.prefix"), F.col(f"{p}.middle"), F.col(f"{p}.suffix")
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    counted = lambda c: F.when(f != PLAIN, F.length(c).cast("bigint"))
    result = F.struct(F.col(n).alias("n"), f.alias("form"), F.when(f == PSM, psm).when(f == SPM, spm).otherwise(F.col(t)).alias("output"), counted(prefix).alias("prefix_chars"), counted(middle).alias("middle_chars"))
    return formed.select(f"{inner}.*", result.alias(name))


def restored(form: Column, output: Column) -> Column:
    """The text behind an output, from it and its form alone; null where either is null.

    No marker is in such a text, and a marker's end is no other marker's start, so the three found are the three set.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).when(form == SPM, F.concat(parts[2], parts[3], parts[1]))


def digest(rows: DataFrame, name: str = "fim", id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of outputs and of the texts rebuilt from them."""
    f = F.col(name)
    return rows.select(F.col(id_col).alias("doc_id"), f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored(f["form"], f["output"]), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""
