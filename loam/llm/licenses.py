"""License scans with a positional index of rare tokens; DataFrame functions only.

Every notice has mandatory key phrases. Document frequencies of all license words are counted over the whole corpus; of each key
phrase the KEYS words with the highest IDF are its index keys. A file whose words hold no key of any phrase is done. In the others
the places of all keys are listed once; for a phrase, the places of its keys, each less its place in the phrase, are intersected,
and what remains is verified word by word. A verified place is scored by the share of the whole notice's words that stand at
their relative places. Everything happens within a row: no shuffle but of the document frequencies of a few hundred words.

Cases: null and empty texts have no words, no labels and score 0; overlapping places all count; repeated rows are each reported;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What stands between words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEYS = 3


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str  # mandatory
    text: str  # contains the phrase
    base: bool = False


NOTICES = (
    Notice("mit", "under the mit license", "under the mit license", True),
    Notice("apache-2", "apache license version 2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", "cc by nc", True),
    Notice("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Notice("mit", "the mit license", "released under the mit license"),
    Notice("apache-2", "the apache license", "licensed under the apache license version 2 0"),
    Notice("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    Notice("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    Notice("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    Notice("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    Notice("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Notice("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Notice("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    Notice("proprietary", "all rights reserved", "copyright all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words, in order. Only A-Z are to be lower-cased: two other letters whose lower case has ASCII are set aside first."""
    text = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("İ"), F.lit("é")), F.lit("K"), F.lit("é"))
    return F.array_remove(F.split(F.lower(text), GAP), "")


def literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """In how many rows each of the given words stands."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), literal(words))).alias("w"))
    return {r.w: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def keys_of(notice: Notice, df: dict[str, int]) -> list[tuple[int, str]]:
    """(place in the phrase, word) of its highest-IDF words, that is those in the fewest rows."""
    words = notice.phrase.split()
    return sorted(sorted(enumerate(words), key=lambda x: (df.get(x[1], 0), x[0]))[:KEYS])


def _starts(notice: Notice, keys: list[tuple[int, str]]) -> Column:
    """Verified places of the phrase, from columns ``hits`` (word, place of each key) and ``words``."""

    def of_key(place: int, word: str) -> Column:
        return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["i"] - place)

    found = [of_key(t, w) for t, w in keys]
    phrase = notice.phrase.split()
    return F.filter(reduce(F.array_intersect, found), lambda s: (s >= 0) & (F.slice("words", s + 1, len(phrase)) == literal(phrase)))


def _share(notice: Notice, starts: Column) -> Column:
    """The largest share of the notice's words that stand at their places, over the starts; 0 without any."""
    text, phrase = notice.text.split(), notice.phrase.split()
    off = next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i - off).alias("r")) for i, w in enumerate(text)])

    def one(s: Column) -> Column:
        there = F.filter(places, lambda x: (s + x["r"] >= 0) & (F.get("words", s + x["r"]) == x["w"]))
        return F.size(there) / F.lit(float(len(text)))

    return F.coalesce(F.array_max(F.transform(starts, one)), F.lit(0.0))


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    df = frequencies(docs, sorted({w for n in notices for w in n.phrase.split()}))
    keys = [keys_of(n, df) for n in notices]
    # A phrase stands only where its rarest key does; the files that hold none of those are left out of the search.
    rarest = sorted({min(k, key=lambda x: (df.get(x[1], 0), x[0]))[1] for k in keys})
    every = sorted({w for k in keys for _, w in k})
    rows = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    search = F.arrays_overlap("words", literal(rarest))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.when(search, F.filter(placed, lambda x: F.array_contains(literal(every), x["w"])))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(search, F.col("words")).alias("words"), hits.alias("hits"))
    rows = rows.select("doc_id", "n_words", "words", *[_starts(n, k).alias(f"s{i}") for i, (n, k) in enumerate(zip(notices, keys, strict=True))])
    base = F.concat(*[F.coalesce(f"s{i}", F.array().cast("array<int>")) for i, n in enumerate(notices) if n.base])

    def labels(which) -> Column:
        found = F.array(*[F.when(F.size(f"s{i}") > 0, F.lit(n.label)) for i, n in enumerate(notices) if which(n)])
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(found))))

    shares = F.greatest(*[_share(n, F.col(f"s{i}")) for i, n in enumerate(notices)])
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        labels(lambda n: n.base).alias("base_labels"), labels(lambda n: True).alias("labels"), F.when(F.col("words").isNull(), 0.0).otherwise(shares).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in DuckDB, by looking for every phrase at every place."""
    chars = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    array = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(
        f"({i}, '{n.label}', {str(n.base).lower()}, {array(n.phrase.split())}, {array(n.text.split())}, "
        f"{n.text.split().index(n.phrase.split()[0]) if n.text.split()[n.text.split().index(n.phrase.split()[0]):][: len(n.phrase.split())] == n.phrase.split() else 0})"
        for i, n in enumerate(NOTICES)
    )
    return f"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^{chars}]+') as w from documents),
    n(k, label, base, phrase, body, off) as (values {rows}),
    u as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
    f as (select u.r, n.k, n.label, n.base, u.i, n.body, n.off, d.w from u join n on u.x = n.phrase[1] join d on d.r = u.r where d.w[u.i : u.i + len(n.phrase) - 1] = n.phrase),
    g as (select r, label, base, i, list_sum(list_transform(range(1, len(body) + 1), lambda j: case when i - off + j - 1 >= 1 and w[i - off + j - 1] = body[j] then 1 else 0 end))::double / len(body) as share from f),
    h as (select r, count(*) filter (base) as n_base, min(i - 1) filter (base) as first_word, max(i - 1) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from g group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join h using (r)
    """


ORACLE = _oracle()
