"""A crude language guess for filling quotas: script first, then distinct function words against English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions.text import tokens

# Scripts in the order they are tried, by character range.
SCRIPTS = {
    "cyrillic": "[Ѐ-ӿ]", "hebrew": "[֐-׿]", "arabic": "[؀-ۿ]", "greek": "[Ͱ-Ͽ]",
    "thai": "[฀-๿]", "kana": "[぀-ヿ]", "hangul": "[가-힯]", "han": "[一-鿿]",
}
# Function words of each language, in the order in which ties are decided.
FUNCTION_WORDS = {
    "es": "que para pero porque dinero cuenta mis una muy no",
    "pt": "que não nao para dinheiro conta meu uma muito mas",
    "fr": "que pas pour argent compte mon une très tres mais je",
    "de": "und nicht für fur geld konto mein eine sehr aber ich",
    "it": "che non per soldi conto mio una molto ma io",
    "tr": "ve değil degil için icin para hesap benim bir çok cok ama",
    "nl": "en niet voor geld rekening mijn een heel maar ik",
    "pl": "nie dla pieniądze pieniadze konto moje bardzo ale ja",
}
ENGLISH = "the and to of is was were my they them you your for that this have has had not with but it would will been from when after because about"
UNSURE, LEAST_CHARS, LEAST_HITS = "en_or_unknown", 3, 3


def hits(words: Column, vocabulary: str) -> Column:
    return F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in vocabulary.split()))))


def guess_language(text: Column) -> Column:
    """The first script with three characters; else the language with most distinct function words, if it beats English."""
    turkish = tokens(F.regexp_replace(F.lower(text), "['’]ve|ve['’]", " "))  # contractions are no Turkish
    both = F.array(F.struct(F.array_distinct(tokens(text)).alias("w"), F.array_distinct(turkish).alias("t")))

    def decide(x: Column) -> Column:
        scores = F.array(*(F.struct(hits(x["t"] if lang == "tr" else x["w"], listed).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, listed) in enumerate(FUNCTION_WORDS.items())))
        found = F.array(F.struct(F.array_max(scores).alias("best"), hits(x["w"], ENGLISH).alias("english")))
        better = lambda y: (y["best"]["n"] > y["english"]) & ((y["best"]["n"] >= LEAST_HITS) | (y["english"] == 0))
        return F.get(F.transform(found, lambda y: F.when(better(y), y["best"]["lang"]).otherwise(UNSURE)), F.lit(0))

    latin = F.get(F.transform(both, decide), F.lit(0))  # words are taken once, in a one-element array
    for name, pattern in reversed(SCRIPTS.items()):
        latin = F.when(F.regexp_count(text, F.lit(pattern)) >= LEAST_CHARS, name).otherwise(latin)
    return latin
