"""Line-first quality rules, in DataFrame functions only.

Every line is judged: by its punctuation (symbols, shouting), as navigation (separators between words, links, runs of
short lines without an end) and as boilerplate (stock phrases). Failing lines are removed, and a document that loses more than ``most_lost``
of its word characters that way is rejected. Word and repetition counts of the whole text are returned beside.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import UPPER, WORD_BREAK, let

SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "||", "»", "›", "•", "·", "::"]
#: Lower-case phrases of notices, forms and licence lines.
BOILERPLATE = [
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "log in to", "lorem ipsum", "powered by",
    "privacy policy", "read more", "share this", "sign up", "subscribe to", "terms of service", "terms of use", "use cookies",
]
#: The like in other languages, for the parameter ``boilerplate``; a language costs some 80 CPU seconds a GB.
MORE_BOILERPLATE = {
    "de": ["alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "javascript aktivieren", "jetzt anmelden", "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "verwendet cookies"],
    "fr": ["abonnez-vous", "activer javascript", "cliquez ici", "conditions d’utilisation", "conditions d'utilisation", "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés", "utilise des cookies"],
    "es": ["aviso legal", "habilitar javascript", "haga clic aquí", "iniciar sesión", "leer más", "política de privacidad", "suscríbete a", "términos de uso", "todos los derechos reservados", "utiliza cookies"],
}
_B, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SHORT = rf"^{_B}*{_W}+({_B}+{_W}+){{0,2}}{_B}*\z"
ENDED = rf"""[.!?:;,…][]'")»”]*{_B}*\z"""


def _count(text: Column, chars: str) -> Column:
    """Characters of text that are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _count_of(text: Column, pair: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(pair), F.lit("")))) / len(pair)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda x: x != "")


def _chars(words: Column) -> Column:
    """Characters of all the words."""
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))


def _phrase(lower: Column, boilerplate: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(lower, F.lit(p)) for p in boilerplate], F.lit(False))


def _link(text: Column) -> Column:
    return F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))


def line_fails(line: Column, phrases: Column | bool = True, links: Column | bool = True, boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """Whether a line with at least one word breaks a rule that can be told from the line alone.

    Punctuation: at least 3 symbols of ``SYMBOLS`` and more than one for every 2 words; ``!!`` or ``??`` after a
    quarter of the words or more; more than half of the word characters (of 8 or more) in A-Z. Navigation: a fifth of
    the words or more are separators, or a third are links. Boilerplate: a phrase of ``boilerplate``.

    phrases, links: false where the whole text is known to hold none, so that its lines are not searched.
    """
    phrases, links = (F.lit(x) if isinstance(x, bool) else x for x in (phrases, links))

    def judge(words: Column) -> Column:
        n = F.size(words)
        return (
            (F.size(F.filter(words, lambda x: x.isin(SEPARATORS))) * 5 >= F.greatest(n, F.lit(1)))
            | (F.rlike(line, F.lit(f"[{SYMBOLS}]")) & let(_count(line, SYMBOLS), lambda k: (k >= 3) & (k * 2 > n)))
            | ((_count_of(line, "!!") + _count_of(line, "??")) * 4 >= n)
            # capitals that a small letter follows are half of the characters at most
            | (F.rlike(line, F.lit("[A-Z](?![a-z])")) & let(_chars(words), lambda k: (k >= 8) & (_count(line, UPPER) * 2 > k)))
            | (links & (F.size(F.filter(words, _link)) * 3 >= F.greatest(n, F.lit(1))))
            | (phrases & _phrase(F.lower(line), boilerplate))
        )

    return let(_words(line), judge)


def short(line: Column) -> Column:
    """Whether a line has three words or fewer and no end of a sentence or clause."""
    return F.rlike(line, F.lit(SHORT)) & ~F.rlike(line, F.lit(ENDED))


def in_menu(shorts: Column, i: Column) -> Column:
    """Whether line i is one of three or more short lines in a row: a menu or a list of links."""
    at = lambda k: F.coalesce(F.get(shorts, i + k), F.lit(False))
    return at(0) & ((at(-1) & (at(1) | at(-2))) | (at(1) & at(2)))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that stand in a window of so many words found twice or more in the list, the first included."""

    def marked(hashes: Column) -> Column:
        def spread(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            ours = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            places = F.array_sort(F.transform(ours, lambda k: F.get(s, k)["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(
                places, start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(window), p - acc["last"])).alias("total")), lambda acc: acc["total"]
            )

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, spread))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.when(F.size(w) < window, 0).otherwise(let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])), marked))

    return let(F.transform(words, lambda x: F.xxhash64(x)), windows)  # each word is hashed once


def measured(docs: DataFrame, text_col: str = "text", most_lost: float = 0.5, boilerplate: Sequence[str] = BOILERPLATE) -> DataFrame:
    """docs with one more column ``q``: a struct of the counts, clean_text, base_failed and kept.

    A null text counts as empty: no words, so base_failed. Lines are cut at line feeds; lines without a word are
    neither judged nor kept in clean_text. Words come by ASCII white space, characters are code points.
    base_failed: fewer than 20 words, or over 30 % of them repeated in 8-word windows (windows are compared by a
    64-bit hash of their words' hashes). boilerplate: lower-case phrases that mark a line as such, in any language: see
    MORE_BOILERPLATE. kept: not base_failed, and at most most_lost of the word characters in failing
    lines. Very long texts are judged whole, repeated rows alike. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_text(words: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            def clean_of(known: Column) -> Column:
                fails = lambda x, i: in_menu(known["shorts"], i) | line_fails(x, known["phrases"], known["links"], boilerplate)
                return F.filter(lines, lambda x, i: ~fails(x, i))

            known = F.struct(F.transform(lines, short).alias("shorts"), _phrase(F.lower(text), boilerplate).alias("phrases"), _link(text).alias("links"))
            good = let(known, clean_of)

            def verdict(g: Column) -> Column:
                n, repeated = F.size(words).cast("long"), repeated_words(words).cast("long")
                clean = F.array_join(g, "\n")
                return let(
                    F.struct(n.alias("n_words"), _chars(words).cast("long").alias("word_chars"), repeated.alias("n_repeat_words"), clean.alias("clean_text")),
                    lambda r: F.struct(
                        r["n_words"].alias("n_words"),
                        r["word_chars"].alias("word_chars"),
                        F.when(F.rlike(text, F.lit(f"[{SYMBOLS}]")), _count(text, SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                        r["n_repeat_words"].alias("n_repeat_words"),
                        r["clean_text"].alias("clean_text"),
                        (F.size(lines) - F.size(g)).cast("long").alias("n_lines_removed"),
                        _chars(_words(r["clean_text"])).cast("long").alias("clean_word_chars"),
                        ((r["n_words"] < 20) | (r["n_repeat_words"] * 100 > r["n_words"] * 30)).alias("base_failed"),
                    ),
                )

            return let(good, verdict)

        return let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(_W))), of_lines)

    def with_verdict(r: Column) -> Column:
        return r.withField("kept", ~r["base_failed"] & ((r["word_chars"] - r["clean_word_chars"]) <= most_lost * r["word_chars"]))

    # inside one expression: a filter on q.kept, pushed below this projection, would else hold it once for each field named
    return docs.withColumn("q", let(let(_words(text), of_text), with_verdict))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5, boilerplate: Sequence[str] = BOILERPLATE) -> DataFrame:
    """id_col and the fields of measured(), one row per input row; other columns are not read."""
    return measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", most_lost, boilerplate).select(F.col("id").alias(id_col), "q.*")


def accepted(docs: DataFrame, text_col: str = "text", most_lost: float = 0.5, boilerplate: Sequence[str] = BOILERPLATE) -> DataFrame:
    """The rows of docs, all columns as they are, that are kept; clean_text is not put in the place of the text."""
    inner = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))  # so columns may have any names
    return measured(inner, "text", most_lost, boilerplate).filter("q.kept").select("row.*")
