"""Fill-in-the-middle examples by zero-width splits, by DataFrame functions alone.

A text is cut into units, two cut points are drawn from a hash of its id, and prefix, middle and suffix change
places around three sentinels. A unit grammar says where one unit may end and the next begin by the classes of the two
neighbouring code points. That is a zero-width regex, a lookbehind of the one class and a lookahead of the other, so a
split at it keeps every code point: the pieces are the units, and joined they are the text. The boundary never holds at a
text's start or end, so no piece is empty but that of an empty text, which is not split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, text_or_empty


@dataclass(frozen=True)
class Unit:
    """A grammar: `match` is a regex whose successive matches are the units; they meet between `before` and `after`."""

    match: str
    before: str
    after: str

    def boundary(self) -> str:
        """The zero-width regex of the places between units. Lookbehinds here take one UTF-16 unit, so `before` is ANY or of the basic plane."""
        return f"(?<={self.before})(?={self.after})"


ANY, SPACE, NO_SPACE = r"[\s\S]", r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
UNITS = {
    "line": Unit(r"[^\n]*\n|[^\n]+", r"\n", ANY),
    "word": Unit(rf"{NO_SPACE}+{SPACE}*|{SPACE}+", SPACE, NO_SPACE),
    "character": Unit(ANY, ANY, ANY),
}
SENTINELS = ("<P>", "<S>", "<M>")


def pieces(text: Column, unit: str) -> Column:
    """The units of a text in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS[unit].boundary(), -1))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key string, from the SHA-256 of seed and key. A null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever they stand beside text that has none of them: no two may overlap."""
    for a in sentinels:
        if not a or any(a != b and a in b for b in sentinels) or any(a[-k:] == b[:k] for b in sentinels for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("sentinels must be different, not empty, and unable to overlap")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must be different")


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: float = 1.0, spm_rate: float = 0.5, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n (units), form, prefix, middle, suffix (null if plain), output.

    rate is the part of texts that are rearranged and spm_rate, of these, the part in the order suffix, prefix,
    middle; both in hundredths. A null text is an empty one. Empty texts and those that contain a sentinel stay plain, as do those not
    chosen. The draws depend on id and seed alone, so rows of one id are cut by the same draws, and a null id is one of no
    digits. Other columns are not read. No row is moved: the plan has no shuffle.
    """
    _checked(sentinels)
    p, s, m = map(F.lit, sentinels)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id").cast("string"), seed)
    rows = rows.select("*", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"), pieces(F.col("text"), unit).alias("units"))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    rows = rows.withColumns({"a": F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int"), "b": F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int")})
    plain = (F.col("text") == "") | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (F.col("h3") % 100 >= round(100 * rate))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < round(100 * spm_rate), "spm").otherwise("psm")
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    rows = rows.withColumn("form", form).select("doc_id", "n", "form", "text", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, (F.col("n") - F.col("b")).cast("int")).alias("suffix"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output, from it and its form alone: what stands between the sentinels, in the old order."""
    _checked(sentinels)
    parts = F.array(F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels), -1))  # read in a lambda, so made once
    joined = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    return F.when(form == "plain", output).otherwise(F.transform(parts, joined)[0])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, {_H}, CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS u FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM f
"""
