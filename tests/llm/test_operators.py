"""Each operator against a brute-force version, on a fixture with nulls, empties, copies, repeats and clashing columns."""

import collections
import hashlib
import json
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash

from loam.llm import decontaminate, langid, licenses, lm, media, mixing, near, pii, simhash, substring, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())


def texts():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeéö"), rng.integers(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(vocab[i] for i in rng.zipf(1.3, n) % 300)
    base = [make(int(n)) for n in rng.integers(1, 160, 40)]
    shared, out = make(60), []
    for i, t in enumerate(base):
        out.append(t + ("\n" + shared if i % 5 == 0 else ""))
    out += [base[3], base[3], base[7].upper(), base[9] + " tail", "one " * 90, "one " * 70, None, "", " \t\n", "é", "x" * 400, "a b", "a b", base[11].replace(" ", "  ", 3)]
    out += [base[20][:50] + " mail me at joe.doe@corp.example.org or +1 (555) 123-4567, joe.doe@corp.example.org", "Released under the MIT License; UNDER THE MIT LICENSE. cc by-nc", "apache license, version 2 apache License Version 2"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "de", None]
    data = [(i, t, langs[i % 3], [None, "b", "a", "a"][i % 4], "clash", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, places string, h int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    out = {r.doc_id: r for r in df.collect()}
    return out


def test_mixing(docs, none, rows):
    small = mixing.sized(docs)
    got = mixing.with_copies(small, mixing.plan_mix(small.cache())).collect()
    size = {i: len(WORD.findall((t or "").encode())) for i, t in rows}
    assert {r.doc_id: r.size for r in got} == size and len(got) == len(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own)
        assert all(0 <= r.copies <= 2 for r in own)
    assert math.isclose(sum({r.source: r.target for r in got}.values()), 1.5 * sum(size.values()))
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    mixed = mixing.mix_documents(docs)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix_documents(none).count() == 0
    clash = mixing.mix_documents(docs.withColumnRenamed("h", "copy").withColumnRenamed("places", "whole"))
    assert clash.columns == ["doc_id", "text", "lang", "source", "whole", "copy", "copy_"] and {r.copy for r in clash.collect()} == {1}


def test_media(spark, docs, none, rows):
    got = by_id(media.payload_features(media.store_texts(docs)))
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * ((-len(b)) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.payload_features(media.store_texts(none)).count() == 0
    stored = media.store_texts(docs).select("doc_id", "media").collect()
    images = spark.createDataFrame([(bytes(stored[0].media), 1), (None, 2), (b"", 3), (b"\xff\xd8junk", 4)], "media binary, width int")
    seen = {r.width_in: r for r in media.image_features(images).collect()}
    assert seen[1].width % 8 == 0 and len(seen[1].thumbnail) == seen[1].width * seen[1].height // 64
    assert [seen[k].width for k in (2, 3, 4)] == [None] * 3


def test_jpeg_with_standard_tables():
    """A colour image with 2x2 sampling, general Huffman codes and restarts, coded by a plain encoder written here."""
    from loam.llm import jpeg

    rng = np.random.default_rng(1)
    table = bytes([0, 2, 3, 3, 4, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes([0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x11, 0x21, 0x31, 0x06, 0xF0, 0x12, 0x41, 0x07])
    code, k, codes = 0, 16, {}
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            codes[table[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    blocks, pred, bits, scan, want = 4 * 6, [0, 0, 0], "", b"", []

    def put(v):
        size = int(abs(v)).bit_length()
        return size, format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for m in range(4):
        if m % 2 == 0:
            pred = [0, 0, 0]
        for part in (0, 0, 0, 0, 1, 2):
            z = np.zeros(64, int)
            z[0] = rng.integers(-15, 16)
            for j in rng.choice(np.arange(1, 40), 4, replace=False):
                z[j] = 0
            z[1], z[3] = 1, -1
            size, extra = put(z[0] - pred[part])
            pred[part] = z[0]
            bits += codes[size] + extra + codes[0x01] + put(1)[1] + codes[0x11] + put(-1)[1] + codes[0x00]
            want.append(z)
        if m % 2 == 1 or m == 3:
            bits += "1" * (-len(bits) % 8)
            scan += b"".join(bytes([int(bits[i : i + 8], 2)]) + (b"\0" if bits[i : i + 8] == "1" * 8 else b"") for i in range(0, len(bits), 8))
            scan += b"" if m == 3 else b"\xff\xd0"
            bits = ""
    frame = bytes([8, 0, 32, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + jpeg.segment(jpeg.DQT, b"\0" + bytes([2] * 64)) + jpeg.segment(jpeg.SOF0, frame) + jpeg.segment(jpeg.DHT, b"\x00" + table + b"\x10" + table)
    img = jpeg.parse(head + jpeg.segment(jpeg.DRI, b"\0\x02") + jpeg.segment(jpeg.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9")
    jpeg.decode([img])
    assert img.coefs.shape == (blocks, 64) and (img.coefs == np.array(want)).all()
    assert jpeg.thumbnail(img).shape == (4, 4)


def test_substring(docs, none, rows):
    got = by_id(substring.without_repeats(docs))
    words = {i: WORD.findall((t or "").encode()) for i, t in rows}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in got.values()) > 300
    assert substring.without_repeats(none).count() == 0


@pytest.mark.parametrize("sorted_most", [16_000, 1])
def test_suffix(docs, none, rows, sorted_most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", sorted_most)
    got = by_id(suffix_dedup.without_later_copies(docs))
    seen = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.without_later_copies(none).count() == 0


def test_suffix_array():
    from loam.llm.suffixsort import Blocks, share_prefix, two_stage

    rng = np.random.default_rng(0)
    for t in range(60):
        text = np.append(rng.integers(0, 4, rng.integers(1, 120)) if t % 3 else np.ones(rng.integers(1, 120), int), 0).astype(np.uint16)
        cut = lambda i: tuple(text[i : i + 1 + int(np.flatnonzero(text[i:] == 0)[0])])  # noqa: E731, B023
        order = two_stage(text)
        assert sorted(order) == list(range(len(text))) and [cut(i) for i in order] == sorted(cut(i) for i in range(len(text)))
        for n in (5, 31):
            for k, same in enumerate(share_prefix(order, Blocks(text), n)):
                a, b = cut(order[k]), cut(order[k + 1])
                assert same == (len(a) > n and len(b) > n and a[:n] == b[:n])


def _contaminated(rows, bench):
    windows = {}
    for i, t in bench:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for i, t in rows:
        w, hit, items = ALNUM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    items |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        yield i, len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontaminate(spark, docs, none, rows, block):
    bench = [(10, " ".join(rows[0][1].split()[:14])), (9, "apache LICENSE"), (8, None), (7, ""), (7, " ".join(rows[5][1].split()[-20:])), (11, "one " * 12)]
    table = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, doc_id int")
    got = by_id(decontaminate.find_contamination(docs, table, block_bytes=block))
    for i, n, hit, items in _contaminated(rows, bench):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0), i
    left = decontaminate.decontaminated(docs, table, block_bytes=block)
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.contaminated} and left.columns == docs.columns
    assert decontaminate.find_contamination(none, table).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_contamination(docs, table.where("false")).collect())


def test_lm(docs, none, rows):
    got = by_id(lm.score_documents(docs, head=20))
    tokens = {i: WORD.findall(lower(t)) + [b""] for i, t in rows}
    count = collections.Counter(w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm.score_documents(none).count() == 0


def test_lattice_sums_all_segmentations():
    from loam.llm.lattice import Lattice

    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    p = dict(zip(pieces, [0.1, 0.2, 0.3, 0.15, 0.05, 0.2], strict=True))

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, min(2, len(s)) + 1) if s[:k] in p)

    got = np.exp(Lattice(pieces, np.log([p[x] for x in pieces])).score([b"abab", b"b", b"ab" * 40]))
    assert np.allclose(got, [total(b" abab"), total(b" b"), got[2]]) and got[2] > 0
    short = Lattice(pieces, np.log([p[x] for x in pieces]))
    assert math.isclose(short._long(b" abab"), math.log(total(b" abab")))
    expect = np.zeros(len(pieces))
    short.score([b"abab"], expect)
    assert math.isclose(float(short.by_piece(expect) @ [len(x) for x in pieces]), 5)


def test_pii(docs, none, rows):
    got = by_id(pii.replace_entities(docs, b"key"))
    find = pii.Detector()
    made = {}
    for i, t in rows:
        found = find(t or "")
        assert got[i].n_entities == len(found)
        if not found:
            assert got[i].text == t
        for a, b in zip(found, find(got[i].text or ""), strict=True):
            assert a.kind == b.kind and a.norm != b.norm and made.setdefault(a.norm, b.norm) == b.norm
    assert len(set(made.values())) == len(made) == 2
    assert pii.replace_entities(none, b"key").count() == 0
    assert pii.with_surrogates(docs, b"key").columns == docs.columns
    assert {r.doc_id: r.text for r in pii.replace_entities(docs, b"key", most_sent=0).collect()} == {i: r.text for i, r in got.items()}


def test_surrogates_are_distinct_and_no_real_entities(spark):
    """Also where a format's strings are all taken: each single-digit address, all listed names, names of two letters."""
    from loam.llm.surrogates import GIVEN, Surrogates

    real = [("ssn", f"{i:03d}-11-2233") for i in range(300)] + [("ip", f"1.2.3.{i}") for i in range(10)]
    real += [("name", n) for names in GIVEN.values() for n in names] + [("name", a + b) for a in "bdfghklmnprst" for b in "aeiou"]
    made = Surrogates(b"k")
    real += [("name", made(*x)) for x in real if x[0] == "name"]  # first draws that are entities themselves
    real = sorted(set(real))
    table = spark.createDataFrame(real, "kind string, norm string")
    odd = {(r.kind, r.norm): r.surrogate for r in pii.redrawn(table, b"k").collect()}
    final = {x: odd.get(x) or made(*x) for x in real}
    taken = {(k, s) for (k, _), s in final.items()}
    assert len(odd) > 100 and len(taken) == len(real) and not taken & set(real)
    script = lambda w: unicodedata.name(w[0]).split()[0]
    assert all(script(n) == script(s) for (k, n), s in final.items() if k == "name")


def test_formats_are_kept():
    from loam.llm.surrogates import Surrogates, dressed, luhn

    made = Surrogates(b"k")
    card = made("card", "4111 1111 1111 1111")
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", card) and luhn([int(c) for c in card if c.isdigit()])
    iban = made("iban", "de89 3704 0044 0532 0130 00")
    plain = iban.replace(" ", "").upper()
    assert re.fullmatch(r"de\d\d( \d{4}){4} \d\d", iban) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"\+49 \d{2} \d{7}", made("phone", "+49 30 1234567")) and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.example\.org", made("email", "joe.doe@corp.example.org"))
    assert re.fullmatch(r"[0-9a-f]{32}", made("secret", "0123456789abcdef" * 2)) and re.fullmatch(r"[1-9]\d [a-z]{4} street", made("address", "12 main street"))
    assert re.fullmatch(r"\w+straße \d", made("address", "hauptstraße 5")) and len(made("name", "王伟")) == 2 and made("name", "петрова")[-1] == "а"
    assert dressed("abcd", "ANNA") == "ABCD" and dressed("abcdef", "ANNA") == "ABCDEF" and dressed("abcdef", "Anna") == "Abcdef"
    assert len({made("ssn", "123-45-6789", k) for k in range(8)}) == 8 and len(made("ssn", "123-45-6789", 6)) == 14


def test_planted_entities_are_replaced(spark):
    """A list written by hand, not by the detector; nothing else of the texts changes, whatever other columns are called."""
    planted = [
        ("Write to {} or call {}.", ["anna.k@corp.example.org", "+44 20 7946 0958"]),
        ("Tel. {}, card {}", ["030 1234567", "4111 1111 1111 1111"]),
        ("Господин {} пишет письмо.", ["Павел"]),
        ("Κύριος {} γράφει", ["Νίκος"]),
        ("Herr {} kommt; Frau {} geht.", ["王伟", "Ольга"]),
        ("He lives at {} now, she at {}.", ["12 Main Street", "Hauptstraße 5"]),
        ("Host {} and SSN {} and key '{}'", ["10.20.30.40", "123-45-6789", "abcdEFGH1234abcdEFGH1234"]),
        ("{} {} met Mr {} there. {} smiled.", ["Maria", "Keller", "Dubois", "Keller"]),
        ("No entity: 12 apples, version 1.2.3, the year 2024, main street, господин пишет.", []),
    ]
    data = [(i, t.format(*e), i, "x", [1], t, "k", 7) for i, (t, e) in enumerate(planted)]
    docs = spark.createDataFrame(data, "doc_id long, text string, own int, doc string, found array<int>, row string, kinds string, n_entities int")
    out = pii.with_surrogates(docs, b"key")
    assert out.schema == docs.schema
    for most in (0, 1000):
        got = {r.doc_id: r for r in pii.with_surrogates(docs, b"key", most_sent=most).collect()}
        for i, (t, entities) in enumerate(planted):
            m = re.fullmatch(re.escape(t).replace(r"\{\}", "(.+?)"), got[i].text)
            assert m and all(new != old for new, old in zip(m.groups(), entities, strict=True)), got[i].text
            assert (got[i].own, got[i].doc, got[i].found, got[i].row, got[i].kinds, got[i].n_entities) == (i, "x", [1], t, "k", 7)
        a = re.fullmatch(r"(\w+) (\w+) met Mr (\w+) there\. (\w+) smiled\.", got[7].text)
        assert a[2] == a[4]


def _fingerprint(t):
    w = WORD.findall(lower(t))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4000, 2])
def test_simhash(spark, docs, none, rows, bucket, monkeypatch):
    prints = {i: _fingerprint(t) for i, t in rows}
    found = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert found == prints
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**64, 40, np.uint64)]
    for f in fps[:20]:  # chains of two flipped bits each
        for _ in range(4):
            f ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.append(f)
    fps = sorted(set(fps))
    root = {f: f for f in fps}
    for _ in range(8):
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from loam.llm.components import components

    star = {r.u: r.v for r in components(simhash.linked(nodes, bucket=bucket)).collect()}
    groups = collections.defaultdict(set)
    for f in fps:
        groups[star.get(signed(f), signed(f))].add(f)
    want = collections.defaultdict(set)
    for f in fps:
        want[root[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    if bucket > 2:
        got = by_id(simhash.with_components(docs))
        assert got[40].component_id == 3 and got[46].component_id == 46 and got[48].component_id == 46
        assert simhash.with_components(none).count() == 0


def test_near_copies(spark, none):
    rng = np.random.default_rng(3)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    data, base = [], [make(200) for _ in range(30)]
    for k, w in enumerate(base):
        data.append((k, " ".join(w)))
        for j in range(3 if k < 10 else 0):
            v = list(w)
            v[int(rng.integers(200))] = "changed"
            data.append((100 + 10 * k + j, " ".join(v)))
    data += [(500, " ".join(base[0])), (501, None), (502, ""), (None, "a b c")]
    data += [(600, "a b c d e f g h"), (601, "a b c d e f g h i"), (7, "two texts with one id"), (7, " ".join(base[7]))]
    docs = spark.createDataFrame([(*x, 1, "c") for x in data], "doc_id long, text string, i int, h string")
    got = {r.doc_id: r.group for r in near.near_copy_groups(docs).where("doc_id <> 7").collect()}
    for k in set(range(30)) - {7}:
        assert got[k] == k
    assert all(got[100 + 10 * k + j] == k for k in range(10) for j in range(3)) and got[500] == 0 and got[502] == 501 and got[601] == 600
    kept = near.one_of_near_copies(docs)
    assert kept.schema == docs.schema
    kept = kept.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*range(30), 7, 501, 600]) and sum(r.doc_id is None for r in kept) == 1
    assert len({r.text for r in kept if r.doc_id == 7}) == 2
    assert near.near_copy_groups(none).count() == 0 and near.one_of_near_copies(none).count() == 0


def test_langid(spark, none):
    rng = np.random.default_rng(4)
    sets = {"aa": ["the", "and", "thing", "is", "of", "with"], "bb": ["der", "und", "nicht", "über", "das", "ein"]}
    data = [(i, " ".join(rng.choice(sets[s], 20)), s, 1) for i in range(120) for s in [["aa", "bb"][i % 2]]]
    data += [(200, None, "aa", 1), (201, "123 ...", "aa", 1), (202, "", None, 1), (203, "Über " * 3000, None, 1), (None, "the and", "aa", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    got = by_id(langid.identify(docs))
    held = [(i, s) for i, _, s, _ in data[:120] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out and got[i].lang_pred == s for i, s in held) and len(held) > 20
    assert [got[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and got[203].lang_pred == "bb" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.in_known_language(docs).where("doc_id in (200, 201, 202)").count() == 0
    assert langid.identify(none).count() == 0
    assert langid.identify(docs.where("lang is null")).where("lang_pred <> 'und'").count() == 0


def test_bigru_gradients():
    from loam.llm.bigru import BiGRU

    net = BiGRU(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq, y = np.array([[1, 2, 3], [4, 1, 250]]), np.array([0, 2])
    _, g = net.gradients(seq, y)
    for k, at in (("fu", (1, 3)), ("bn", (2, 2)), ("fx", (1, 5)), ("bb", (7,)), ("w", (3, 1))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = net.gradients(seq, y)[0]
        net.p[k][at] = old - 1e-2
        down = net.gradients(seq, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-3


def test_licenses(docs, none, rows):
    got = by_id(licenses.scan_licenses(docs))
    base = [(n.label, n.phrase.encode().split()) for n in licenses.NOTICES if n.base]
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        places = [(k, label) for label, p in base for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), i
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(none).count() == 0


def test_pipeline_entry():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n for n in range(1, 11)} <= {int(x[2:].split("_")[0]) for x in names if re.match(r"op\d+_", x)}
    assert json.dumps(sorted(__spark_entry__.oracle_sql()))
