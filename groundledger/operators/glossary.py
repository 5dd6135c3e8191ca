"""Expected terms given with a recording."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C


def parse(text: Column) -> Column:
    terms = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(terms, 1, C.GLOSSARY_CAP)


def prompt(terms: Column) -> Column:
    """"Glossary: a, b, c"; stops at the first term that would pass the length limit."""
    start = F.struct(F.lit("Glossary: ").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, term: Column) -> Column:
        nxt = F.concat(acc["text"], F.when(acc["text"] != "Glossary: ", ", ").otherwise(""), term)
        full = acc["full"] | (F.length(nxt) > C.GLOSSARY_PROMPT_CHARS)
        return F.struct(F.when(full, acc["text"]).otherwise(nxt).alias("text"), full.alias("full"))

    kept = F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.aggregate(kept, start, add)["text"])
