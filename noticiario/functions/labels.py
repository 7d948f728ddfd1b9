"""Label and title functions as Spark columns.

Nulls: functions that give text give the empty text for null unless they say otherwise, like the system
they are compared with; predicates give false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticiario.functions import lexicon as L
from noticiario.functions.text import SPACE, fold, strip, unaccent


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any_word(words: list[str]) -> str:
    return "|".join(words)


def words(c: Column) -> Column:
    """Words between white space; none for blank and null texts."""
    return F.filter(F.split(_text(c), "(?U)\\s+"), lambda w: w != "")


def key_norm(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(_text(c)), "[^a-z0-9]+", "")


def mention_norm(c: Column) -> Column:
    """Folded words with single spaces."""
    return F.btrim(F.regexp_replace(fold(_text(c)), "[^a-z0-9]+", " "))


def label_words(c: Column) -> Column:
    """Folded words without stop words, repeated ones included."""
    return F.filter(F.split(F.btrim(F.regexp_replace(fold(_text(c)), "[^a-z0-9]+", " ")), " "), lambda t: (t != "") & ~t.isin(L.STOPWORDS))


def label_norm(c: Column) -> Column:
    return F.array_join(label_words(c), " ")


def title_norm(c: Column) -> Column:
    """A title for comparison: without the outlet after a spaced bar or dash, without a lead before a colon if ten characters follow, folded."""
    short = strip(F.regexp_replace(_text(c), "(?U)\\s+[|–—-]\\s+[^|–—-]+$", ""))
    rest = strip(F.regexp_replace(short, "^[^:]*:", ""))
    cut = F.when((F.instr(short, ":") > 0) & (F.length(rest) >= 10), rest).otherwise(short)
    return F.btrim(F.lower(F.regexp_replace(unaccent(cut), "[^\\p{L}\\p{N}_]+", " ")))


def title_output(c: Column) -> Column:
    """A title for the report, without a last part after a bar that has only words. Null stays null."""
    return strip(F.regexp_replace(c, "(?U)\\s*\\|\\s*[\\w\\s]+$", ""))


def snippet(c: Column) -> Column:
    """A text for the report: breaks and ``[...]`` to spaces, from the first capital on, ending in ``...``. Null stays null."""
    flat = strip(F.regexp_replace(c, "(?U)<br>|\\[\\.\\.\\.\\]|\\s+", " "))
    at = F.regexp_instr(flat, F.lit("[A-ZÁÉÍÓÚÑ]"))
    start = F.when(at > 0, F.substr(flat, at)).otherwise(flat)
    return F.when((start == "") | start.endswith("..."), start).otherwise(F.concat(F.regexp_replace(start, "[.]+$", ""), F.lit("...")))


def url_norm(c: Column) -> Column:
    """A link without scheme, ``www.``, outer white space and closing slashes, in lower case. Null, empty and the word nan give an empty text."""
    s = F.regexp_replace(F.lower(strip(_text(c))), "^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, "^www[.]", ""), "/+$", "")
    return F.when(s.isin("nan", "none", "null"), "").otherwise(s)


def file_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(unaccent(_text(c))), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "marca").otherwise(s)


def hyperlink(c: Column) -> Column:
    """The target of a cell that is a link formula; else null."""
    return F.nullif(F.regexp_extract(c, '=HYPERLINK\\("([^"]+)"', 1), F.lit(""))


def restore_accents(c: Column, lexicon: dict[str, str] = L.ACCENTS) -> Column:
    """Whole words in the lexicon, their plurals in -s, and words in -cion or -sion get their accents back; an initial capital stays. White space becomes single spaces."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])

    def one(w: Column) -> Column:
        low = F.lower(w)
        plural = F.when(low.endswith("s"), F.concat(F.element_at(table, F.regexp_replace(low, "s$", "")), F.lit("s")))
        found = F.coalesce(F.element_at(table, low), plural, F.regexp_replace(low, "([cs])ion$", "$1ión"))
        capital = F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 10**6))
        return F.when(found == low, w).when(F.substring(w, 1, 1) != F.substring(low, 1, 1), capital).otherwise(found)

    return F.array_join(F.transform(words(c), one), " ")


def capitalise(c: Column) -> Column:
    """A label in lower case with accents and an initial capital; ``Sin tema`` for blank ones."""
    s = restore_accents(F.lower(c))
    return F.when(s == "", "Sin tema").otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 10**6)))


def _bare(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), "[.,;:!?]+$", "")


def is_complete(c: Column) -> Column:
    """Whether a label doesn't end in a word that asks for another, or in a single character."""
    last = _bare(F.element_at(F.concat(F.array(F.lit("")), words(c)), -1))
    return ~unaccent(last).isin(L.TRAILING) & (F.length(last) > 1)


def trim_label(c: Column, most: int = 7) -> Column:
    """The first ``most`` words without trailing incomplete ones; the first word if all are; ``Sin tema`` for blank labels."""
    w = words(c)
    head = F.slice(w, 1, most)
    kept = F.array_max(F.transform(head, lambda x, i: F.when(~unaccent(_bare(x)).isin(L.TRAILING), i + 1).otherwise(0)))
    return F.when(F.size(w) == 0, "Sin tema").when(kept == 0, F.element_at(w, 1)).otherwise(F.array_join(F.slice(head, 1, F.greatest(F.lit(1), kept)), " "))


def clean_topic(c: Column) -> Column:
    """A label as a model may give it: without quotes and known prefixes, five words at most, capitalised."""
    s = F.regexp_replace(strip(_text(c)), "^[\"']+|[\"']+$", "")
    # each prefix once, in their order; one pattern, as a chain of conditions would repeat the label's expression in each
    s = F.regexp_replace(s, "(?iu)^" + "".join(f"(?:{p}{SPACE}*)?" for p in L.LABEL_PREFIXES), "")
    return capitalise(trim_label(s, 5))


def _not_a_headline(c: Column) -> Column:
    return ~c.rlike(f"(?iU)^({_any_word(L.HEADLINE)})\\b") & ~c.rlike(f"(?iU)\\b({_any_word(L.STATE)})\\s*$")


def valid_subtopic(c: Column) -> Column:
    """Two to five words, not like a headline; with a connective after the first word if four words or fewer."""
    s = _text(c)
    w = words(s)
    linked = F.exists(F.slice(w, 2, 10), lambda x: unaccent(_bare(x)).isin(L.CONNECTIVES))
    return F.size(w).between(2, 5) & _not_a_headline(s) & ((F.size(w) == 5) | linked)


def valid_topic(c: Column) -> Column:
    """Two to five words, not starting with a number, not like a headline, not generic."""
    s = _text(c)
    return F.size(words(s)).between(2, 5) & ~s.rlike("^[0-9]") & ~s.rlike(f"(?iU)^({_any_word(L.NUMBER_WORDS)})") & _not_a_headline(s) & ~label_norm(s).isin(L.GENERIC_TOPICS)


def distinctive(c: Column, least: int = 4) -> Column:
    """Distinct label words of at least ``least`` letters that aren't weak or numbers."""
    each = F.array_distinct(F.split(F.regexp_replace(fold(_text(c)), "[^a-z0-9]+", " "), " "))
    return F.filter(each, lambda t: (F.length(t) >= least) & ~t.isin([*L.STOPWORDS, *L.WEAK]) & ~t.rlike("^[0-9]+$"))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two word arrays; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def action_conflict(a: Column, b: Column) -> Column:
    """Whether two word arrays (:func:`distinctive` with ``least=3``) hold opposed actions."""
    out = F.lit(False)
    for x, y in L.OPPOSED:
        x, y = F.array(*map(F.lit, x)), F.array(*map(F.lit, y))
        out = out | (F.arrays_overlap(a, x) & F.arrays_overlap(b, y)) | (F.arrays_overlap(a, y) & F.arrays_overlap(b, x))
    return out


def conflict_bits(words: Column) -> Column:
    """Which sets of opposed actions a word array (of three letters on) hits, two bits a pair of sets."""
    out = F.lit(0)
    for k, (x, y) in enumerate(L.OPPOSED):
        for side, w in enumerate((x, y)):
            out = out + F.when(F.arrays_overlap(words, F.array(*map(F.lit, w))), 1 << (2 * k + side)).otherwise(0)
    return out


def opposed_bits(a: Column, b: Column) -> Column:
    left, right = sum(1 << (2 * k) for k in range(len(L.OPPOSED))), sum(2 << (2 * k) for k in range(len(L.OPPOSED)))
    low = lambda c: c.bitwiseAND(F.lit(left))
    high = lambda c: F.shiftright(c.bitwiseAND(F.lit(right)), 1)
    return (low(a).bitwiseAND(high(b)) != 0) | (high(a).bitwiseAND(low(b)) != 0)


def embedding_text(title: Column, summary: Column, most: int = 1800) -> Column:
    """The title three times and the summary, cut at ``most`` characters; null counts as empty."""
    t, r = strip(_text(title)), strip(_text(summary))
    return F.substring(F.concat(t, F.lit(". "), t, F.lit(". "), t, F.lit(". "), r), 1, most)
