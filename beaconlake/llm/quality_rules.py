"""Quality rules, lines first: drop failing lines, then reject documents that lose too much text.

All rules are column expressions over one row; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
# Boilerplate phrases of web pages and notices in the languages of the corpus (fixed list of this operator).
BOILERPLATE = (
    r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies|click here|read more|"
    r"sign (in|up)|log ?in|subscribe to|javascript is (required|disabled)|powered by|copyright (\(c\)|©)|share (this|on)|back to top|"
    r"alle rechte vorbehalten|datenschutzerklärung|cookies akzeptieren|hier klicken|mehr lesen|weiterlesen|nach oben|"
    r"tous droits réservés|politique de confidentialité|accepter les cookies|cliquez ici|lire la suite|haut de page|"
    r"todos los derechos reservados|política de privacidad|aceptar (las )?cookies|haga clic|leer más|volver arriba)\b"
)
TERMINAL = r"[.!?…。！？:;][\"'”»)\]]*\s*$"
SEPARATORS = "[|»›>•·]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on the document.

    ``mark_share``: symbol characters, or doubled exclamation or question marks, per word of a line.
    ``bare_words``: a line of so many words, from the first to the second number, that ends without a closing mark fails, as list and navigation
    fragments do; a longer one is prose. ``separators``: navigation separators that make a line a menu. ``boiler_words``: a line of at most so many
    words that holds a boilerplate phrase fails; in a longer one the phrase is too small a share. ``max_loss``: share of word characters a document may lose.
    """

    mark_share: float = 0.3
    bare_words: tuple[int, int] = (4, 16)
    separators: int = 3
    boiler_words: int = 12
    max_loss: float = 0.4
    min_words: int = 50
    max_repeat_percent: int = 50


def line_fails(line: Column, words: Column, symbols: Column, rules: LineRules = LineRules()) -> Column:
    """Punctuation, navigation and boilerplate rules for one line, given its number of words and of symbol characters.

    A line without words never fails. Each test is put behind a cheaper one that most lines decide.
    """
    marks = symbols + F.regexp_count(line, F.lit(r"[!?]{2,}"))
    bare = (words >= rules.bare_words[0]) & (words <= rules.bare_words[1]) & ~line.rlike(TERMINAL)
    navigation = line.rlike(SEPARATORS) & (F.regexp_count(line, F.lit(rf"(^| ){SEPARATORS}(?= |$)")) >= rules.separators)
    boilerplate = (words <= rules.boiler_words) & line.rlike(BOILERPLATE)
    return (words > 0) & (bare | boilerplate | (marks >= words * rules.mark_share) | navigation)


def window_hashes(words: Column) -> Column:
    """Hashes of the three-word windows, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included, from the windows' hashes."""
    # Most texts repeat no window; then the distinct hashes are as many as the windows, and nothing has to be ordered.
    keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(keyed)

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        hit = F.array_sort(F.array_compact(F.transform(s, lambda e, i: F.when(same(e, i + 1) | same(e, i - 1), e["i"]))))
        return F.get(F.transform(F.array(hit), lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)), F.lit(0))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.get(F.transform(F.array(ordered), covered), F.lit(0))).cast("bigint")


def measured(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the counts, the cleaned text and the verdict in columns led by ``prefix``.

    Each line is tested once. Null texts have no words and are rejected; rows are judged alone, so repeated rows get the same verdict.
    """
    c = lambda name: F.col(prefix + name)
    name = lambda expr, key: expr.alias(prefix + key)
    text = text_of(text_col)
    line = lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.regexp_count(x, F.lit(SYMBOLS)).alias("symbols"))
    total = lambda key: F.aggregate(c("lines"), F.lit(0).cast("bigint"), lambda n, x: n + x[key])
    step = docs.select("*", name(words_of(text), "words"), name(F.transform(F.split(text, "\n"), line), "lines"))
    step = step.select(
        *docs.columns, c("words"), c("lines"), name(window_hashes(c("words")), "hashes"),
        name(F.transform(F.filter(c("lines"), lambda x: x["words"] > 0), lambda x: x["line"]), "worded"),
        name(F.transform(F.filter(c("lines"), lambda x: ~line_fails(x["line"], x["words"], x["symbols"], rules)), lambda x: x["line"]), "clean_lines"),
    )
    step = step.select(
        *docs.columns, name(F.size(c("words")).cast("bigint"), "n_words"), name(F.char_length(F.array_join(c("words"), "")).cast("bigint"), "word_chars"), name(total("symbols"), "n_symbols"),
        name((F.size(c("worded")) - F.size(F.array_distinct(c("worded")))).cast("bigint"), "n_dup_lines"),
        name(repeat_words(c("hashes")), "n_repeat_words"), name(F.array_join(c("clean_lines"), "\n"), "clean"), name(F.size(c("lines")) - F.size(c("clean_lines")), "n_failed_lines"),
    )
    left = F.char_length(F.array_join(words_of(c("clean")), ""))
    step = step.select(
        "*", name((c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words")), "base_failed"),
        name(F.when(c("n_failed_lines") == 0, c("word_chars")).otherwise(left).cast("bigint"), "clean_chars"),
    )
    lost = c("word_chars") - c("clean_chars") > rules.max_loss * c("word_chars")
    return step.withColumn(prefix + "kept", ~c("base_failed") & ~lost)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "clean_chars")


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id and the counts and verdict of each row."""
    return measured(docs.select("doc_id", "text"), rules).select("doc_id", *(F.col("_q_" + k).alias(k) for k in COUNTS))


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents with their failing lines removed; all columns stay, ``n_chars`` follows the text where there is one."""
    prefix = "_q_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = "_" + prefix
    c = lambda name: F.col(prefix + name)
    # The generator keeps the filter from being pushed under the counts, which would compute them once for each mention.
    verdict = F.explode(F.array(F.struct(c("kept").alias("kept"), c("n_failed_lines").alias("failed"), c("clean").alias("clean")))).alias(prefix + "v")
    out = measured(docs, rules, prefix=prefix).select(*docs.columns, verdict).filter(F.col(prefix + "v.kept"))
    text = F.when(F.col(prefix + "v.failed") == 0, F.col("text")).otherwise(F.col(prefix + "v.clean"))
    size = F.char_length(F.col("text"))
    out = out.select(*(text.alias("text") if x == "text" else F.col(x) for x in docs.columns))
    return out.select(*(size.cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else F.col(x) for x in docs.columns))
