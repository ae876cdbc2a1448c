"""Fill-in-the-middle rows by escaped marker injection, on DataFrame functions alone.

The text's own delimiters are escaped, regexp_replace puts one delimiter after each unit, the delimiters are counted, and
substring_index takes the parts before and after the ranked ones, in time linear in the text. Parts lose their delimiters
and their escapes and are assembled around the marks; the marks tell `restored` where a part ends, so a text that has a mark of its
own stays plain. An escape pair is one unit, as the character that it stands for is.

A null text is empty, an empty text stays plain, and a null doc_id counts as an empty string in its hash. Repeated rows get the same cuts, long texts
stay in one row, empty tables give empty results, columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, the escape character, and what the two become in a text.
_END, _ESC = "\x01", "\x02"
_PAIRS = {_ESC: _ESC + "0", _END: _ESC + "1"}
#: A unit of an escaped text: letters, an escape pair, or any other character.
_UNIT = f"[A-Za-z]+|{_ESC}[01]|[^A-Za-z]"


def _marked(text: Column) -> Column:
    for plain, pair in _PAIRS.items():
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return F.regexp_replace(text, _UNIT, f"$0{_END}")


def _unmarked(part: Column) -> Column:
    part = F.replace(part, F.lit(_END), F.lit(""))
    for plain, pair in reversed(_PAIRS.items()):
        part = F.replace(part, F.lit(pair), F.lit(plain))
    return part


def _index(text: Column, mark: str, count) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), count if isinstance(count, Column) else F.lit(count))


def draws(doc_id: Column, n: int, seed: str = "1") -> list[Column]:
    """n unsigned 32-bit numbers that the seed and the id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, form, prefix, middle, suffix, output), one for each row of docs.

    n is the number of units; the parts are null where form is `plain`. Of 100 texts 100 - plain_from stay plain by the draw, and
    spm_below of 100 of the others have the suffix first.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        own = own | F.contains("text", F.lit(mark))
    h1, h2, h3, h4 = draws(F.col("doc_id"), 4, seed)
    form = F.when((F.col("text") == "") | own | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    d = d.withColumn("form", form).withColumn("marked", _marked(F.col("text")))
    d = d.withColumn("n", F.length("marked").cast("long") - F.length(F.replace("marked", F.lit(_END), F.lit(""))))
    at = [h % (F.col("n") + 1) for h in (h1, h2)]
    d = d.withColumn("low", F.least(*at).cast("int")).withColumn("high", F.greatest(*at).cast("int"))
    d = d.withColumn("head", _index(F.col("marked"), _END, F.col("high")))
    # the head has no delimiter after its last unit, the marked text has: counted from behind, one more makes up for it
    parts = {"prefix": _index(F.col("marked"), _END, F.col("low")), "middle": _index(F.col("head"), _END, F.col("low") - F.col("high")), "suffix": _index(F.col("marked"), _END, F.col("high") - F.col("n").cast("int") - 1)}
    d = d.withColumns({k: F.when(F.col("form") != "plain", _unmarked(v)) for k, v in parts.items()})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return d.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from, by its marks alone."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    after = lambda x, mark: F.substr(x, F.length(_index(x, mark, 1)) + len(mark) + 1)
    second = F.when(form == "psm", after(body, SUFFIX)).otherwise(after(body, PREFIX))
    first = F.when(form == "psm", _index(body, SUFFIX, 1)).otherwise(_index(body, PREFIX, 1))
    then, middle = _index(second, MIDDLE, 1), after(second, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    chars = lambda c: F.length(c).cast("long")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        chars("prefix").alias("prefix_chars"),
        chars("middle").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: Lists of units and slices of them, in place of delimiters and ranks.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, [CAST('0x' || substr(s, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, us, len(us) AS n, h, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
