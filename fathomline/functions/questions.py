"""Follow-up questions: whether one leans on the conversation, and what a rewriting model's reply leaves as the query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Words that point back, by language; those of one language that are everyday words of another are left out.
POINTING = {
    "en": """it its it's this that these those they them their theirs he him his she her hers one ones same above previous earlier former latter instead there
then another such both either neither else""",
    "es": "eso esto esa ese esas esos estas estos ello él ella ellos ellas sus mismo misma anterior otro otra entonces allí ahí",
    "de": """das diese dieser dieses diesem diesen sie ihm ihn ihr ihre ihren ihrem dafür dazu davon darüber damit dabei dort dann dasselbe derselbe vorherige andere""",
    "fr": "elle ils elles lui leur leurs sa ses ce cela ça ceci celui celle ceux celles là alors même précédent autre",
    "pt": "isso isto aquilo ele ela eles elas dele dela deles delas seu sua seus suas então lá ali outra",
    "it": "esso essa questo questa questi queste quello quella quelli ciò lei loro suo suoi sue stesso precedente altro altra allora lì",
}
POINTING_CJK = "它 这 那 其 此 それ これ あれ その この 그것 이것 저것".split()
#: Words that carry a question on; first words and openings that do.
CARRYING = """more detail details detailed elaborate explain expand continue further again too other others rest remaining first second third fourth fifth last next
prior below point points step steps part parts example examples summarize summarise summary list happens happen after afterwards before otherwise
detalles explica explícame erkläre erklär genauer détails explique dettagli spiega detalhes""".split()
FIRST, OPENINGS = "and but so also or plus y und et".split(), ("what about", "how about", "what if", "why not", "what else")
#: Words without a signal for retrieval, by language.
EMPTY = {
    "en": """a an the and or but so also about of for to in on at by with from as is are was were be been do does did can could will would should may might must
have has had what which who whom whose when where why how many much any some me my we our you your i if not no yes please tell say""",
    "es": """de la le lo il di al su es o e el los las una unos unas y pero del en por para sobre qué cuál cuáles quién cuándo dónde cómo cuánto cuántos cuánta
cuántas está están hay se mi nos sí también muy más""",
    "de": """der den dem des ein eine einen einem einer und oder aber von zu für mit auf im bei über wer wie wann wo warum welche welcher welches viele viel ist
sind gibt haben kann muss ich wir mir uns nicht kein auch noch bitte""",
    "fr": """les une du et ou mais à au aux dans pour avec quel quelle quels quelles qui quand où comment combien pourquoi est sont faut je nous ne oui aussi""",
    "pt": "os um uma da dos das em na nas qual quais quem quando onde como quanto quantos quantas é são há eu meu minha não também",
    "it": "gli uno della nel che quale quali chi perché è sono ci io mio anche",
}
WORD = r"\p{L}++(?:-\p{L}++)*+"
#: A question needs so many words of its own; two CJK characters count as one. A rewrite of more characters is an answer.
OWN, LONGEST = 3, 400
#: What a reply may put before the question, and around it.
PREAMBLE = r"(?i)^(?:here(?:'s| is)|sure|okay|ok|certainly)\b[^:\n]{0,60}:\s*"
LABEL = r"(?i)^(?:the\s+)?(?:standalone|rewritten|reformulated|rephrased|search|follow-up)?\s*(?:question|query)\s*:\s*"
_WRAP = "[\"'`*“”‘’ ]+"


def _list(table: dict[str, str] | list[str]) -> Column:
    flat = table if isinstance(table, list) else [w for words in table.values() for w in words.split()]
    return F.split(F.lit(" ".join(dict.fromkeys(flat))), " ")


def needs_condense(question: Column) -> Column:
    """Whether a question can't stand alone as a query: it points back, carries on, or has too few words of its own. In doubt it can't.

    A null question is an empty one.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    found = F.regexp_extract_all(q, F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(found, lambda w: F.split(w, "-")))
    cjk = F.array_join(F.regexp_extract_all(q, F.lit(T.CJK), F.lit(0)), "")
    back = F.arrays_overlap(parts, _list(POINTING)) | F.arrays_overlap(parts, F.array(*map(F.lit, CARRYING))) | cjk.rlike("|".join(POINTING_CJK))
    first = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    opens = first.isin(FIRST) | F.concat_ws(" ", F.slice(found, 1, 2)).isin(*OPENINGS)
    own = F.filter(found, lambda w: ~F.array_contains(_list(EMPTY), w) & ~w.rlike(T.CJK))
    return back | opens | (F.size(own) + F.floor(F.char_length(cjk) / 2) < OWN)


def _bare(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), f"^{_WRAP}|{_WRAP}$", "")


def condensed(output: Column, question: Column) -> Column:
    """{query, note}: the query in a rewriting model's reply: its first line that holds text without labels, lead-ins and quotes.

    note: null where the reply was the query, else cleaned, empty, or why it was rejected; then the query is empty. Nulls are empty.
    """
    out = F.coalesce(output, F.lit(""))
    lines = F.transform(F.split(out, r"\r\n|[\n\r]"), lambda x: _bare(F.regexp_replace(F.regexp_replace(_bare(x), PREAMBLE, ""), LABEL, "")))
    text = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    long = F.char_length(text) > F.greatest(4 * F.char_length(F.coalesce(question, F.lit(""))), F.lit(LONGEST))
    note = F.when(text == "", "empty").when(long, "rejected: longer than a question").when(text != plain, "cleaned")
    return F.struct(F.when(long, "").otherwise(text).alias("query"), note.alias("note"))
