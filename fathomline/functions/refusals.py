"""Answers that decline: whether an answer says that its sources don't hold what was asked, in six languages.

A clause grammar over folded text (small letters, no accents, contractions spelled out). A hint says that something is not
there. A sentence declines if its last clause does, counted after contrasts. It opens with a refusal if it declines, speaks
of the sources, and gave nothing before it first turned (an aside or a contrast). An answer declines if its first sentence
opens with a refusal and no later one that cites or contrasts gives anything.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import numerals as N
from fathomline.functions import text as T

#: Phrases that say the sources don't suffice (folded), by language; BOUND ones only beside a word for the sources.
HINTS = {
    "en": ("enough information", "insufficient", "do not contain", "does not contain", "cannot answer"),
    "es": ("suficiente informacion", "informacion suficiente", "no contienen", "no contiene", "no puedo responder"),
    "de": ("nicht genugend informationen", "nicht genug informationen", "keine ausreichenden informationen", "enthalten nicht", "enthalt nicht", "nicht beantworten"),
    "fr": ("pas suffisamment d'informations", "pas assez d'informations", "informations insuffisantes", "ne contiennent pas", "ne contient pas", "ne peux pas repondre"),
    "pt": ("informacoes suficientes", "informacao suficiente", "nao contem", "nao posso responder"),
    "it": ("informazioni sufficienti", "non contengono", "non contiene", "non posso rispondere"),
}
BOUND = ("insufficient", "do not contain", "does not contain")
#: Further phrases by which a sentence declines; they alone don't spare an answer its retry.
SOFT = (
    "not specified", "does not specify", "do not specify", "not mentioned", "does not mention", "do not mention", "does not say", "do not say",
    "does not state", "do not state", "does not provide", "do not provide", "does not address", "do not address", "does not discuss", "do not discuss",
    "does not include", "do not include", "unrelated", "not related", "no information", "none of these", "none of the",
)
NOTHING = r"\bno\b(?:\s+[\w-]+){0,4}?\s+(?:information|details|mention)\b"
#: Words for the sources; where a sentence turns; an aside; what sources are about.
SOURCES = r"\b(?:documents?|context|sources?|passages?|excerpts?|texts?|information|provided|policy|policies|handbook|manual|guide|file|pdf)\b"
LOOSE_SOURCES = SOURCES + r"|\b(?:docs?|data|details)\b"
CONTRAST = r"(?:,|;)\s*(?:but|however|although|though|except)\b|^\s*(?:but|however|although|though|that said|still|nevertheless|nonetheless|instead)\b"
ASIDE = r"\s[-–—]\s|\s*[–—]\s*|;"
ABOUT = (
    r"^\s*(?:\[\d[^\]]*\][\s,]*(?:(?:and|,)\s*\[\d[^\]]*\][\s,]*)*|(?:the |these |other )?(?:provided |given |retrieved |available )?"
    r"(?:context|documents?|sources?|passages?|excerpts?|texts?|sections?)\b)"
    r"[^.]*?\b(?:discuss(?:es)?|cover(?:s)?|focus(?:es)?|describe(?:s)?|is about|are about|pertain(?:s)?|relate(?:s)?|deal(?:s)? with|concern(?:s)?|talk(?:s)? about)\b"
)
#: A figure, not a digit inside a name.
FIGURE = r"(?<!\p{L})\p{Nd}"
#: Fixed value: where a text is cut into sentences for quoting, as positions are told.
SENTENCE = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])|(?<=[。！？])\s*|\n{2,}|\n(?=\|)|\s+(?=#{1,6}\s)|\n+"


def _unaccented() -> tuple[str, str]:
    """Letters that Unicode composes of one base character and marks, and these bases."""
    found = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)) for c in range(a, b)]
    kept = [(c, base) for c, base in found if len(base) == 1 and base != c]
    return "".join(c for c, _ in kept), "".join(base for _, base in kept)


ACCENTED, BARE = _unaccented()


def folded(text: Column) -> Column:
    """Small letters without accents, straight apostrophes, "not" written out."""
    plain = F.translate(F.regexp_replace(F.translate(F.lower(text), ACCENTED, BARE), r"\p{Mn}+", ""), "’", "'")
    return F.regexp_replace(F.regexp_replace(plain, r"\bcan't\b", "cannot"), r"n't\b", " not")


def unmarked(text: Column) -> Column:
    """A text without its citation markers and the spaces before them."""
    return F.trim(F.regexp_replace(text, r"[ \t]*" + N.MARKER, ""))


def _any(phrases: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases)


_ALL = tuple(p for ps in HINTS.values() for p in ps)
FREE, TIED, DECLINING = _any(tuple(p for p in _ALL if p not in BOUND)), _any(BOUND), _any(_ALL + SOFT) + "|" + NOTHING


def declines(sentence: Column, about_sources: bool = False) -> Column:
    """Whether a folded sentence ends by saying the sources don't have it; about_sources: or only says what they are about."""
    text = unmarked(sentence)
    out = F.element_at(F.split(text, CONTRAST, -1), -1).rlike(DECLINING)
    return out | (sentence.rlike(ABOUT) & ~text.rlike(FIGURE)) if about_sources else out


def opens_with_refusal(sentence: Column) -> Column:
    """Whether a folded sentence declines, about the sources, and not after giving something."""
    first = F.split(F.split(sentence, ASIDE, 2)[0], CONTRAST, 2)[0]
    nothing_first = (first == sentence) | ~unmarked(first).rlike(r"\p{L}")
    return declines(sentence) & unmarked(sentence).rlike(SOURCES) & (nothing_first | declines(first, True))


def sentences(text: Column) -> Column:
    """The sentences of an answer that hold a letter besides markers, outer white space off."""
    return F.filter(F.transform(F.split(text, SENTENCE, -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: unmarked(s).rlike(r"\p{L}"))


def declines_to_answer(answer: Column) -> Column:
    """Whether an answer cites sources only to say that they don't answer it."""
    found = F.transform(sentences(answer), lambda s: folded(s))
    speaks = lambda s: (F.size(T.cited_numbers(s, F.lit(1000))) > 0) | s.rlike(CONTRAST)
    rest = F.slice(found, F.lit(2), F.greatest(F.lit(0), F.size(found) - 1))
    return F.coalesce(opens_with_refusal(F.get(found, F.lit(0))) & ~F.exists(rest, lambda s: speaks(s) & ~declines(s, True)), F.lit(False))


def only_declines(answer: Column) -> Column:
    """Whether every sentence of an answer says that the sources don't have it."""
    found = F.transform(sentences(answer), lambda s: folded(s))
    rest = F.slice(found, F.lit(2), F.greatest(F.lit(0), F.size(found) - 1))
    return F.coalesce(opens_with_refusal(F.get(found, F.lit(0))) & F.forall(rest, lambda s: declines(s, True)), F.lit(False))


def states_insufficiency(answer: Column) -> Column:
    """Whether an answer declares its sources insufficient, so that it need not cite."""
    low = folded(answer)
    return low.rlike(FREE) | F.exists(F.split(low, T.SENTENCE_END), lambda s: s.rlike(TIED) & s.rlike(LOOSE_SOURCES))


def status(answer: Column, sources: Column) -> Column:
    """no_context, insufficient_context, uncited or answered. A null answer is an empty one."""
    a = F.coalesce(answer, F.lit(""))
    declined = states_insufficiency(a) | only_declines(a)
    uncited = F.size(T.cited_numbers(a, sources)) == 0
    return (
        F.when(sources <= 0, "no_context").when(uncited & declined, "insufficient_context").when(uncited, "uncited")
        .when(declines_to_answer(a), "insufficient_context").otherwise("answered")
    )


def needs_retry(answer: Column, sources: Column) -> Column:
    """Whether an answer should be asked for again: sources were there, none is cited, and it isn't a refusal."""
    a = F.coalesce(answer, F.lit(""))
    return (sources > 0) & (F.size(T.cited_numbers(a, sources)) == 0) & ~states_insufficiency(a)
