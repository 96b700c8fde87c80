"""Names by title and context, and language samples with repeated ids."""

import random
import zlib

import pytest

from loam.llm import langid, pii
from loam.llm.surrogates import Detector, maybe

NAMED = {
    "My name is Olga Petrova. Later Olga left.": ["Olga Petrova", "Olga"],
    "Frau Dr Weber kam, Weber ging.": ["Weber", "Weber"],
    "Sincerely,\nWei Zhang": ["Wei Zhang"],
    "I saw Mr. Smith and Prof. Dr. Ada Lovelace.": ["Smith", "Ada Lovelace"],
    "Меня зовут Ольга Петрова.": ["Ольга Петрова"],
    "my name is not here, Dear All": [],
    "To: everyone. From: here": [],
}


@pytest.mark.parametrize("text", NAMED)
def test_names(text):
    found = [text[x.start : x.end] for x in Detector()(text) if x.kind == "name"]
    assert found == NAMED[text] and (maybe(text.encode()) or not found)


def test_no_title_goes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(NAMED)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace_entities(docs, b"k").collect()}
    for i, (t, names) in enumerate(NAMED.items()):
        assert all(n not in out[i] for n in names) and out[i].split()[:1] == t.split()[:1]
    assert out[1].startswith("Frau Dr ") and "Prof. Dr. " in out[3]


def test_key_of_an_application(spark):
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.secret_key(spark) == pii.secret_key(spark) and pii.secret_key(spark) != pii.query_key(spark)
    spark.conf.set(pii.KEY_SETTING, "given")
    assert pii.secret_key(spark) == b"given"
    spark.conf.unset(pii.KEY_SETTING)


def test_every_language_is_learned_where_all_share_an_id(spark):
    """All rows have one id, one language has nearly all of them; reruns see the same sample."""
    rng, shared = random.Random(1), next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(shared, " ".join(word("aeioubcd") for _ in range(30)), "aa") for _ in range(2000)] + [(shared, " ".join(word("xyzwvutq") for _ in range(30)), "bb") for _ in range(5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [sorted(tuple(r)[1:] for r in langid.identify(df.repartition(n)).collect()) for n in (7, 3)]
    assert found[0] == found[1] and sum(r[1] == "bb" for r in found[0]) == 15


@pytest.mark.parametrize("shared", [False, True])
def test_least_hashes(spark, shared):
    """All rows below the bound are there, and enough of them, whether hashes are uniform or nearly all the same."""
    rng = random.Random(7)
    sizes = {"aa": 20_000, "bb": 40, "cc": 1500}
    rows = [(lang, 2**62 if shared and rng.random() < 0.99 else rng.randrange(-(2**63), 2**63), rng.randrange(5 if shared else 2**60)) for lang, n in sizes.items() for _ in range(n)]
    got = [tuple(r) for r in langid.least_hashes(spark.createDataFrame(rows, "lang string, h long, t long"), sizes).collect()]
    for lang, n in sizes.items():
        every, own = sorted({r for r in rows if r[0] == lang}), sorted(r for r in got if r[0] == lang)
        assert own == every[: len(own)] and len(own) >= min(langid.PER_LANGUAGE, len(every)) and (shared or len(own) < 6 * langid.PER_LANGUAGE)
