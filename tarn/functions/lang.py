"""Language identification (U10), by a stand-in for the language model.

The model file that the operator calls for is not here. The stand-in scores a
text by how many of its words are among a language's most frequent function
words, which needs no Python: it is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import all_pieces

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on was be with as by at are this from not have or an".split(),
    "fr": "le la les de des du et un une que qui dans pour par sur pas est au avec plus ne se ce".split(),
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "el la los las de que y en un una por con no para se su al lo como es del más".split(),
}


def detect(text: Column) -> Column:
    """The language of the whole ``text``, whose newlines are deleted; ``und`` (undetermined)
    without any known word. Words are cut once and counted in one pass over them."""
    words = F.transform(all_pieces(F.replace(text, F.lit("\n"), F.lit(""))), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]+$", ""))
    zero = F.struct(*[F.lit(0).alias(lang) for lang in FUNCTION_WORDS])

    def count(acc: Column, w: Column) -> Column:
        return F.struct(*[(acc[lang] + w.isin(*known).cast("int")).alias(lang) for lang, known in FUNCTION_WORDS.items()])

    def best(acc: Column) -> Column:
        top = F.array_max(F.array(*[F.struct(acc[lang].alias("n"), F.lit(lang).alias("lang")) for lang in FUNCTION_WORDS]))
        return F.when(top["n"] > 0, top["lang"]).otherwise("und")

    return F.aggregate(words, zero, count, best)
