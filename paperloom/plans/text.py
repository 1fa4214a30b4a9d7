"""Queries over cleaning, notation, titles and other scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cleaning, notation, similarity
from paperloom.plans.fixtures import derived, literal, outline, stems, strip, with_sql
from paperloom.registry import query, spread, table

_SPACED = "regexp_replace(content, '[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', ' ', 'g')"
_TIDY = "array_to_string(list_transform(string_split(@, chr(10)), lambda l: " + strip("regexp_replace(l, '[ \\t]{2,}', ' ', 'g')") + "), chr(10))"
_NO_CONTROLS = "regexp_replace(content, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


def _over_derived(f, name: str = "result"):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived(spark, sf_dir).select("doc_id", f(F.col("content")).alias(name))

    return run


def _register(name: str, f, sql: str | None) -> None:  # noqa: ANN001
    """A scalar function over the derived documents, and its SQL over the column content."""
    query(name, with_sql("derived", f"SELECT doc_id, {sql} AS result FROM derived") if sql else None)(_over_derived(f))


_register("clean_nfkc", cleaning.nfkc, None)
_register("clean_ligatures", lambda c: cleaning.expand_ligatures(F.replace(F.replace(c, F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))), "content")
_register("clean_control", cleaning.drop_controls, _NO_CONTROLS)
_register("clean_spaces", cleaning.tidy_spaces, _TIDY.replace("@", _SPACED))
_register("clean_blank_lines", cleaning.limit_blank_lines, "regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g')")
_register("clean_text", cleaning.clean, strip("regexp_replace(" + _TIDY.replace("@", _SPACED.replace("content", _NO_CONTROLS)) + ", '\\n{3,}', chr(10) || chr(10), 'g')"))


def tex_sql(column: str = "content") -> str:
    """Two characters that do not occur in text stand for the backslash and the braces until the end."""
    x = f"replace(replace(replace({column}, chr(92), chr(2)), '{{', chr(3)), '}}', chr(4))"
    for c in "&%$#_":
        x = f"replace({x}, {literal(c)}, {literal(chr(92) + c)})"
    for c, good in (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        x = f"replace({x}, {literal(c)}, {literal(good)})"
    for c, good in (("chr(2)", r"\textbackslash{}"), ("chr(3)", r"\{"), ("chr(4)", r"\}")):
        x = f"replace({x}, {c}, {literal(good)})"
    return x


_register("latex_escape", notation.escape_tex, tex_sql())
_register("snippet", notation.snippet, "concat(" + strip("substr(content, 1, 500)") + ", CASE WHEN length(content) > 500 THEN ' …' ELSE '' END)")
_CUT = "CASE WHEN contains(substr(b, 1, 1400), '.') AND 1400 - instr(reverse(substr(b, 1, 1400)), '.') > 700 THEN substr(b, 1, CAST(1400 - instr(reverse(substr(b, 1, 1400)), '.') + 1 AS BIGINT)) ELSE substr(b, 1, 1400) END"
query("evidence_truncate", with_sql("derived", f"SELECT doc_id, CASE WHEN length(b) > 1400 THEN concat({_CUT}, ' …') ELSE b END AS result FROM (SELECT doc_id, trim(content) AS b FROM derived)"))(_over_derived(notation.evidence))
_register("estimate_tokens", notation.estimate_tokens, "CAST(greatest(1, length(content) // 4) AS INTEGER)")
_register("estimate_prompt_tokens", lambda c: F.floor((F.length(c) + 2400) / 4).cast("int"), "CAST((length(content) + 2400) // 4 AS INTEGER)")
_register("truncated_body", lambda c: F.substring(c, 1, 120), "substr(content, 1, 120)")
_register("tokens_alpha3", lambda c: F.array_join(similarity.alpha_tokens(c), " "), "array_to_string(regexp_extract_all(content, '[a-zA-Z]{3,}'), ' ')")


@query("export_filename", "SELECT page_id, string_split(url, '/')[-1] AS result FROM pages")
def export_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("result"))


@query("outline_title_clean", with_sql("outline", "SELECT doc_id, seq, regexp_replace(trim(regexp_replace(trim(title), '(?i)^(?:(?:chapter|section|part|unit|lecture|module|appendix|slide)\\s*[\\d.]*\\s*[:\\-–]?\\s*|[\\d]+(?:\\.[\\d]+)*\\.?\\s+)', '')), '\\s{2,}', ' ', 'g') AS result FROM outline"))
def outline_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).select("doc_id", "seq", notation.outline_title(F.col("title")).alias("result"))


@query("toc_strip_page", with_sql("outline", "SELECT doc_id, seq, regexp_replace(trim(regexp_replace(title || ' ..... ' || seq, '[\\s.·*]+(\\d{1,4})\\s*$', '')), '[.\\s]{2,}$', '') AS result, seq AS page FROM outline"))
def toc_strip_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("title", F.lit(" ..... "), F.col("seq").cast("string"))
    return outline(spark, sf_dir).select("doc_id", "seq", notation.toc_title(line).alias("result"), notation.toc_page(line).alias("page"))


@query("subtitle_extract", with_sql("outline", "SELECT doc_id, seq, CASE WHEN regexp_matches(title, '(?i)^(Chapter|Part)\\s*[\\d.\\-–]*\\s*$') THEN NULL WHEN starts_with(title, 'Chapter') THEN trim(regexp_extract(title, '[:\\-–]\\s*(.+)$', 1)) ELSE title END AS result FROM outline"))
def subtitle_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).select("doc_id", "seq", notation.subtitle(F.col("title")).alias("result"))


@query("topic_title_norm", with_sql("outline", "SELECT doc_id, seq, trim(regexp_replace(trim(regexp_replace(concat(title, ' ', 100 + seq), '\\s+\\d{1,4}$', '')), '(?i)^(\\d+(\\.\\d+)*|[IVXLC]+\\.?)\\s+', '')) AS result FROM outline"))
def topic_title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).select("doc_id", "seq", notation.topic_title(F.concat("title", F.lit(" "), (100 + F.col("seq")).cast("string"))).alias("result"))


@query("title_case_norm", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS result FROM part")
def title_case_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", notation.title_case(F.col("p_name")).alias("result"))


_OPT = "trim(regexp_replace(regexp_replace(" + strip("lower(stem)") + ", '^\\.+|\\.+$', '', 'g'), '\\s+', ' ', 'g'))"


@query("option_norm", with_sql("stems", f"SELECT question_id, {_OPT} AS result FROM stems"))
def option_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", notation.option_text(F.col("stem")).alias("result"))




@query("stem_fingerprint")
def stem_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("question_id", notation.fingerprint(F.col("stem")).alias("result"))


@query("hash_sha256", "SELECT doc_id, sha256(text) AS result FROM documents")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("result"))


#: Fixed cases: artefact and repaired text, also used by the tests.
MATH_CASES = [("8z: (z 2 x IMPLIES z 2 y)", "∀z: (z∈x ⇒ z∈y)"), ("a IFF b AND NOT c", "a ⇔ b ∧ ¬ c"), (".A D B/", "A = B"), (".x y/", "x ⊆ y"), ("step 2 Is", "step 2 Is"), ("x &le; y", "x ≤ y"), ("a <= b", "a ≤ b"), ("a <== b", "a <== b"), ("n2N", "n∈N")]
MCS_CASES = [(".z∈x ⇔ z∈y/", "(z ∈ x ⇔ z ∈ y)"), ("x = y := ∀z: .z∈x ⇔ z∈y/", "x = y ⇔ ∀z: (z ∈ x ⇔ z ∈ y)"), ("8z: .z 2 x IFF z 2 y/", "∀z: (z ∈ x ⇔ z ∈ y)"), ("n := 5", "n := 5")]


def _spelled(text: str) -> str:
    """text with the connectives that the generated prose writes in capitals as signs."""
    for word, sign in (("AND", "∧"), ("OR", "∨"), ("NOT", "¬"), ("UNION", "∪")):
        text = f"regexp_replace({text}, '\\b{word}\\b', '{sign}', 'g')"
    return text


def _cases(name: str, f, cases: list[tuple[str, str]], text: str = "text") -> None:  # noqa: ANN001
    """Each document's whole text with an artefact before it and one behind it; the oracle has the expected repairs in their place."""
    rows = ", ".join(f"({k}, {literal(good)})" for k, (_, good) in enumerate(cases))

    @query(name, f"SELECT doc_id, concat(a.good, ' #', doc_id, chr(10), {text}, chr(10), 'so ', b.good) AS result FROM documents JOIN (VALUES {rows}) AS a(k, good) ON doc_id % {len(cases)} = a.k JOIN (VALUES {rows}) AS b(k, good) ON (doc_id + 1) % {len(cases)} = b.k")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*(F.lit(bad) for bad, _ in cases))
        artefact = lambda shift: F.get(texts, ((F.col("doc_id") + shift) % len(cases)).cast("int"))
        whole = F.concat(artefact(0), F.lit(" #"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nso "), artefact(1))
        return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", f(whole).alias("result"))


_cases("norm_math", notation.repair_math, MATH_CASES, _spelled("text"))
_cases("norm_def_equiv", notation.definitions_to_equivalence, [("p := ∀x q", "p ⇔ ∀x q"), ("n := 5", "n := 5"), ("a", "a")])
_cases("norm_mcs", notation.repair_notation, MCS_CASES, _spelled("text"))


@query("slot_query", with_sql("stems", "SELECT question_id, trim(concat_ws(' ', CASE WHEN set_id % 4 = 0 THEN NULL ELSE 'Topic ' || set_id END, CASE type WHEN 'mcq' THEN 'key concepts and definitions' WHEN 'true_false' THEN 'facts and statements' WHEN 'short_answer' THEN 'explanations and examples' ELSE 'analysis and discussion' END)) AS result FROM stems"))
def slot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("set_id") % 4 == 0, None).otherwise(F.concat(F.lit("Topic "), F.col("set_id").cast("string")))
    suffix = F.when(F.col("type") == "mcq", "key concepts and definitions").when(F.col("type") == "true_false", "facts and statements").when(F.col("type") == "short_answer", "explanations and examples").otherwise("analysis and discussion")
    return stems(spark, sf_dir).select("question_id", F.trim(F.concat_ws(" ", name, suffix)).alias("result"))
