"""Linguistic structure from a parse table.

Input is a token table ``(ord, sent_id, word_id, text, upos, head, deprel)``
(1-based word ids, ``head = 0`` for a root) produced by an injected parser or
by :func:`textlab.sources.synthetic.derived_parse`. Every operator is a
relational aggregate keyed by ``ord``; nothing iterates per text in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators import phrases
from textlab.operators.vectors import per_worker

# Default entity patterns (valid in Java regex and RE2), tried
# left to right at each position; the first that matches names the type. The
# e-mail pattern starts at a word boundary, so it is not retried inside words.
ENTITY_PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("URL", r"https?://[^\s]+"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("NUMBER", r"[0-9]+(?:[.,][0-9]+)*"),
)
SUBJECT_PREFIX = "nsubj"
HEAD_TAGS = ("NOUN", "PROPN", "PRON")
KEYWORD_TAGS = ("NOUN", "PROPN", "VERB")

PARSE_SCHEMA = ("ord bigint, sent_id int, word_id int, text string, upos string, "
                "head int, deprel string")


def _entity_type(m, patterns=ENTITY_PATTERNS) -> F.Column:
    kind = None
    for name, p in reversed(patterns):
        test = m.rlike(f"^(?:{p})$")
        kind = F.when(test, F.lit(name)) if kind is None else F.when(test, F.lit(name)).otherwise(kind)
    return kind


def entity_array(text: F.Column, patterns=ENTITY_PATTERNS) -> F.Column:
    """N1 inline: ``array<struct<text,type>>`` in text order from one regex pass (no shuffle)."""
    combined = "|".join(f"({p})" for _, p in patterns)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(combined), 0)
    return F.transform(found, lambda m: F.struct(m.alias("text"), _entity_type(m, patterns).alias("type")))


def entities(docs: DataFrame, patterns=ENTITY_PATTERNS) -> DataFrame:
    """N1 (default extractor), flat: ``(ord, ent_ord INT, text, type)`` in text order, duplicates kept."""
    ex = docs.select("ord", F.posexplode(entity_array(F.col("text"), patterns)).alias("ent_ord", "e"))
    return ex.select("ord", F.col("ent_ord").cast("int").alias("ent_ord"),
                     F.col("e.text").alias("text"), F.col("e.type").alias("type"))


def gazetteer_entities(tokens: DataFrame, gazetteer: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """N1 (lookup): gazetteer ``(phrase, type)`` matched against runs of parse tokens of a sentence.

    Phrases of any number of words, joined by single spaces; every occurrence
    counts, overlapping ones too. ``(ord, sent_id, word_id, text, type)`` with the
    first word's id. ``sentences`` are the :func:`phrases.sentence_words` of the tokens, if
    at hand. Each sentence's runs are looked up in a filter of the phrases, and those that it may hold in the
    phrases themselves, see :mod:`textlab.operators.phrases`.
    """
    return phrases.occurrences(phrases.sentence_words(tokens) if sentences is None else sentences, gazetteer)


def subjects(tokens: DataFrame) -> DataFrame:
    """N2 (flat): distinct ``(ord, subject)`` with deprel starting ``nsubj``."""
    return tokens.where(F.col("deprel").startswith(SUBJECT_PREFIX)) \
                 .select("ord", F.col("text").alias("subject")).distinct()


def adj_pairs(tokens: DataFrame) -> DataFrame:
    """``(ord, sent_id, word_id, adjective, subject)`` - adjective -> its nominal head.

    Self equi-join on ``(ord, sent_id, head = word_id)``; duplicates kept; named
    as the pair means: ``adjective`` is the modifier, ``subject`` the head word.
    """
    adj = tokens.where((F.col("upos") == "ADJ") & (F.col("head") != 0)).select(
        "ord", "sent_id", "word_id", F.col("text").alias("adjective"), F.col("head").alias("h"))
    heads = tokens.where(F.col("upos").isin(*HEAD_TAGS)).select(
        "ord", "sent_id", F.col("word_id").alias("h"), F.col("text").alias("subject"))
    return adj.join(heads, ["ord", "sent_id", "h"]).drop("h")


def keywords(tokens: DataFrame) -> DataFrame:
    """N4 (flat): distinct ``(ord, keyword)``: NOUN/PROPN/VERB longer than one code point."""
    return tokens.where(F.col("upos").isin(*KEYWORD_TAGS) & (F.length("text") > 1)) \
                 .select("ord", F.col("text").alias("keyword")).distinct()


def _event_rank() -> F.Column:
    """(sentence, VERB first, word) packed in one BIGINT: sent_id * 2^32 + non_verb * 2^31 + word_id."""
    non_verb = F.when(F.col("upos") == "VERB", 0).otherwise(1).cast("bigint")
    return F.shiftleft(F.col("sent_id").cast("bigint"), 32) + F.shiftleft(non_verb, 31) + F.col("word_id")


def main_event(tokens: DataFrame) -> DataFrame:
    """``(ord, main_event)`` - in the first sentence that has a root, its first
    VERB root, else its first root. One aggregate, no window."""
    roots = tokens.where(F.col("head") == 0)
    return roots.groupBy("ord").agg(F.min_by("text", _event_rank()).alias("main_event"))


def per_text(tokens: DataFrame) -> DataFrame:
    """N2-N5 per text: ``(ord, subjects, keywords, main_event, adj_pairs)``.

    The parse is exchanged once, by ``ord``; both aggregates use that. First
    each sentence gives its words and pairs an adjective with its head (so a
    head is looked up among one sentence's words only), then each text joins
    its sentences' lists, which its own words bound.
    """
    subj = F.col("deprel").startswith(SUBJECT_PREFIX)
    kw = F.col("upos").isin(*KEYWORD_TAGS) & (F.length("text") > 1)
    adj = (F.col("upos") == "ADJ") & (F.col("head") != 0)
    root = F.when(F.col("head") == 0, F.struct(_event_rank().alias("rank"), "text"))
    sentences = tokens.repartition("ord").groupBy("ord", "sent_id").agg(
        F.collect_set(F.when(subj, F.col("text"))).alias("subjects"),
        F.collect_set(F.when(kw, F.col("text"))).alias("keywords"),
        F.min(root).alias("root"),
        F.array_sort(F.collect_list(F.when(adj, F.struct("word_id", F.col("text").alias("adjective"), "head")))).alias("adjs"),
        F.map_from_entries(F.collect_list(F.when(F.col("upos").isin(*HEAD_TAGS), F.struct("word_id", "text")))).alias("heads"))
    pairs = F.transform("adjs", lambda x: F.struct(x["adjective"].alias("adjective"),
                                                   F.try_element_at(F.col("heads"), x["head"]).alias("subject")))
    sentences = sentences.select("ord", "sent_id", "subjects", "keywords", "root",
                                 F.filter(pairs, lambda p: p["subject"].isNotNull()).alias("pairs"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    agg = sentences.groupBy("ord").agg(
        every("subjects"), every("keywords"), F.min("root").alias("root"),
        F.array_sort(F.collect_list(F.struct("sent_id", "pairs"))).alias("p"))
    return agg.select("ord", "subjects", "keywords", F.col("root.text").alias("main_event"),
                      F.flatten(F.transform("p", lambda x: x["pairs"])).alias("adj_pairs"))


def analyze(docs: DataFrame, tokens: DataFrame, ents: DataFrame | None = None) -> DataFrame:
    """One record per text: ``ord, text, entities, subjects, adj_pairs, main_event, keywords``.

    With ``ents(ord, ent_ord, text, type)`` the parser's entities are taken,
    else those of the patterns, inline. The rest comes from one aggregate of
    the parse table. Lists are sorted (subjects, keywords by code point) or kept in
    text order (entities, pairs); texts without tokens get empty lists and a
    NULL event. All joins are on ``ord`` and share its hash partitioning.
    """
    kind = "array<struct<text:string,type:string>>"
    if ents is None:
        out = docs.select("ord", "text", entity_array(F.col("text")).alias("entities"))
    else:
        found = ents.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("ent_ord", "text", "type"))).alias("e"))
        found = found.select("ord", F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"))).alias("e"))
        out = docs.select("ord", "text").join(found, "ord", "left") \
                  .select("ord", "text", F.coalesce("e", F.array().cast(kind)).alias("entities"))
    out = out.join(per_text(tokens), "ord", "left")
    empty = F.array()
    return out.select(
        "ord", "text", "entities",
        F.coalesce("subjects", empty.cast("array<string>")).alias("subjects"),
        F.coalesce("adj_pairs", empty.cast("array<struct<adjective:string,subject:string>>")).alias("adj_pairs"),
        "main_event",
        F.coalesce("keywords", empty.cast("array<string>")).alias("keywords"),
    )


def parse_with(docs: DataFrame, parser_factory: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Injected parser as a ``mapInPandas`` job: text -> parse-table rows.

    ``parser_factory()`` is built once per Python worker and returns a function
    mapping one text to word dicts with ``sent_id, word_id, text, upos, head,
    deprel``.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = per_worker(parser_factory)
        for pdf in it:
            rows = []
            for o, t in zip(pdf["ord"].values, pdf["text"].values):
                for w in parse(t or ""):
                    rows.append((int(o), int(w["sent_id"]), int(w["word_id"]), w["text"],
                                 w["upos"], int(w["head"]), w["deprel"]))
            out = pd.DataFrame(rows, columns=["ord", "sent_id", "word_id", "text", "upos", "head", "deprel"])
            yield out.astype({"ord": "int64", "sent_id": "int32", "word_id": "int32", "head": "int32"})

    return docs.select("ord", "text").mapInPandas(run, PARSE_SCHEMA)
