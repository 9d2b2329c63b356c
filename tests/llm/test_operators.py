"""Corpus operators on small fixtures: odd inputs, ties, brute force, round trips, held-out accuracy."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, oracle
from pyspark.sql import functions as F

from veilframe.llm import classifier, cover_tree, entry, jaccard, mixing, pieces, pii, quality_rules, token_files, url_lists, warc
from veilframe.llm.common import ship, words
from veilframe.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def documents(spark, texts, sources=None, ids=None):
    sources = sources or ["a"] * len(texts)
    ids = ids or list(range(1, len(texts) + 1))
    rows = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "\n\n\t", "one", "one two", "one two three", "é ü ß", "word " * 5000, "a b c", "x\x1cy z", "😀 😀 😀 😀"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    assert_same(entry.queries()[name](spark, small), entry.oracle_sql()[name], small)


def test_words(spark):
    frame = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    for r in frame.select("t", words(F.col("t")).alias("w")).collect():
        assert [w.encode() for w in r.w] == r.t.encode().split()


# quality rules


def brute_rules(text: str | None) -> tuple:
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_text_rules(spark):
    made = random.Random(1)
    texts = ODD + [" ".join(made.choice("a b c #x|".split()) for _ in range(made.randrange(60))) for _ in range(60)] + ["x y\nx y\n\nx y \n" * 3]
    got = quality_rules.text_rules(documents(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def own(i: int, lines: int = 3) -> str:
    return "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(lines))


def test_lines_over_the_limit(spark):
    banner = "Buy   our THING now"
    texts = [own(i) + "\n" + (banner if i % 2 else banner.lower().replace("   ", " ")) for i in range(12)] + [own(100)] * 12 + [own(200), "\n".join([banner] * 40) + "\n" + " ".join(f"z{i}" for i in range(25))]
    sources = ["a"] * 24 + [None, "a"]
    judged = quality_rules.judge(documents(spark, texts, sources)).orderBy("doc_id").collect()
    assert [r.n_removed_words for r in judged[:12]] == [4] * 12
    assert [r.n_removed_words for r in judged[12:25]] == [0] * 13  # copies count once
    assert judged[25].n_removed_words == 160 and not judged[25].kept and all(r.kept for r in judged[:25])
    cleaned = quality_rules.clean(documents(spark, texts, sources).withColumn("line", F.lit(1)).withColumn("host", F.lit("h"))).orderBy("doc_id").collect()
    assert [r.text for r in cleaned[:12]] == [own(i) for i in range(12)]
    assert cleaned[0].n_chars == len(own(0)) and cleaned[0].host == "h"
    assert len(cleaned) == 25 and cleaned[24].text == own(200)


def test_quality_of_nothing(spark):
    empty = documents(spark, [])
    assert quality_rules.judge(empty).count() == 0 and quality_rules.clean(empty).count() == 0


# n-gram Jaccard join


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if either and 100 * both >= 90 * either:
            label[find(a)] = find(b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return [(len(sets[i]), min(groups[find(i)])) for i in range(len(texts))]


def edited(base, made, edits):
    w = list(base)
    for _ in range(edits):
        w[made.randrange(len(w))] = f"e{made.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_components(spark):
    made = random.Random(2)
    texts = list(ODD) + ["One TWO", "ONE", "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven twelve"]
    for size in (9, 12, 30, 90, 200, 1500):
        base = [f"b{size}_{made.randrange(400)}" for _ in range(size)]
        texts += [edited(base, made, made.randrange(1 + max(1, size // 12))) for _ in range(14)] + [" ".join(base)] * 3 + [" ".join(base[: size - size // 11])]
    ids = list(range(len(texts)))
    made.shuffle(ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts, ids=ids).withColumn("node", F.lit(1))).collect()}
    want = dict(zip(ids, brute_components(texts, ids), strict=True))
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 20


def test_jaccard_blocks_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    made = random.Random(3)
    base = [f"q{i}" for i in range(150)]
    texts = [edited(base, made, made.randrange(9)) for _ in range(60)]
    ids = list(range(60))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents(spark, texts, ids=ids)).collect()}
    assert got == {i: c for i, (_, c) in zip(ids, brute_components(texts, ids), strict=True)}


def test_bound_is_never_under_the_overlap(spark):
    made, bands = np.random.default_rng(4), jaccard.Bands()
    rows, want = [], []
    for _ in range(60):
        pool = np.unique(made.integers(0, 2**63, 400, dtype=np.uint64))
        x, y = np.sort(made.choice(pool, made.integers(9, 380), replace=False)), np.sort(made.choice(pool, made.integers(9, 380), replace=False))
        rows.append((len(x), jaccard.bitmap(x, bands).view(np.int64).tolist(), len(y), jaccard.bitmap(y, bands).view(np.int64).tolist()))
        want.append(len(np.intersect1d(x, y)))
    frame = spark.createDataFrame(rows, "n int, a array<long>, m int, b array<long>").coalesce(1)
    got = [r[0] for r in frame.select(jaccard.overlap_bound(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).collect()]
    assert all(g >= w for g, w in zip(got, want, strict=True)) and sum(got) < 1.3 * sum(want)


def test_linked_sets_share_a_tile():
    made, bands = np.random.default_rng(5), jaccard.Bands()
    for _ in range(400):
        n = int(made.integers(9, 400))
        x = np.unique(made.integers(0, 2**64, n, dtype=np.uint64))
        d = int(made.integers(0, len(x) // 9 + 1))
        gone = int(made.integers(0, d + 1))
        y = np.unique(np.r_[made.permutation(x)[gone:], made.integers(0, 2**64, d - gone, dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both) and len(y) >= 9:
            assert len(np.intersect1d(jaccard.tiles(x, bands), jaccard.tiles(y, bands)))


def test_one_of_each(spark):
    texts = [own(1), own(1), own(2), own(2), "", None, own(3)]
    docs = documents(spark, texts, ids=[5, 3, 7, 7, 8, 9, None])
    assert sorted((r.doc_id or -1) for r in jaccard.one_of_each(docs).collect()) == [-1, 3, 7, 8, 9]
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_five_words_and_four_fifths(spark):
    made = random.Random(12)
    texts = []
    for size in (12, 30, 60, 200, 900):
        base = [f"b{size}_{i}" for i in range(size)]
        texts += [edited(base, made, edits) for edits in (0, 1, 2, 4, 9, 20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    want = sorted({label.index(x) for x in label})
    docs = documents(spark, texts, ids=list(range(len(texts))))
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs, size=5, numerator=80).collect()) == want
    assert len(want) < len({c for _, c in brute_components(texts, range(len(texts)))})


def test_one_of_each_tells_texts_of_an_id_apart(spark):
    texts = [own(1), own(2), own(2), own(3), own(4), own(4), own(5), own(5), own(1)]
    ids = [5, 5, 3, 5, 8, None, None, None, 7]
    got = sorted((r.doc_id or -1, r.text) for r in jaccard.one_of_each(documents(spark, texts, ids=ids)).collect())
    assert got == sorted([(5, own(1)), (3, own(2)), (5, own(3)), (8, own(4)), (-1, own(5))])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# personal data


TEXT = "mail a.Bc7@mail3.example.com, card 4111 1111 1111 1111 or 4111111111111112, born 29.02.2000 not 30.02.2000 nor 2000-13-01, 192.168.0.1 not 300.1.1.1, +1 (217) 555-0123, 123-45-6789, token = \"0123456789abcdef0123456789abcdef01234567\"."


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark):
    rows = [(1, TEXT), (2, "again: 4111-1111-1111-1111 / 2000-02-29 a.Bc7@x.org"), (3, None), (4, ""), (5, "clean 12 text, 3.14 and 1234567890123"), (6, TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own column"))
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    new = got[1].text
    for gone in ("a.Bc7@", "4111 1111 1111 1111", "29.02.2000", "192.168.0.1", "555-0123", "123-45-6789", "0123456789abcdef"):
        assert gone not in new
    for kept in ("@mail3.example.com", "4111111111111112", "30.02.2000", "2000-13-01", "300.1.1.1", "+1 ("):
        assert kept in new
    card = new.split("card ")[1][:19]
    assert luhn(card.replace(" ", "")) and card[:4] == "4111"
    assert got[6].text == new and got[1].key == "own column"
    assert got[2].text.split()[1].replace("-", " ") == card  # the same value stays linked, in its own form
    day = new.split("born ")[1][:10]
    assert got[2].text.split()[3] == "-".join(reversed(day.split(".")))
    assert got[2].text.split()[4].split("@")[0] == new.split()[1].split("@")[0]
    assert (got[3].text, got[4].text, got[5].text) == (None, "", rows[4][1])
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1, 1, 1, 1]
    assert [got[5][f"n_{k}"] for k in pii.KINDS] == [0] * 7
    marked = spark.createDataFrame([(1, "an cióNé.34@mail7.example.com,")], "doc_id long, text string")
    local = pii.pseudonymise(marked, "k").first().text
    assert local.startswith("an ") and local.endswith("@mail7.example.com,") and "ció" not in local and "34" not in local
    other = pii.pseudonymise(docs, "another").where("doc_id = 1").first().text
    assert other != new


def brute_string(key: str, kind: str, value: str, alphabet: str) -> str:
    import hashlib

    def shift(step, half, other):
        out = ""
        for i, c in enumerate(half):
            amount = int(hashlib.sha256(f"{key}|{kind}|{step}|{i}|{other}".encode()).hexdigest()[:15], 16)
            out += alphabet[(alphabet.index(c) + amount % len(alphabet)) % len(alphabet)] if c in alphabet else c
        return out

    middle = (len(value) + 1) // 2
    a, b = value[:middle], value[middle:]
    for step in range(pii.ROUNDS):
        a, b = (a, shift(step, b, a)) if step % 2 else (shift(step, a, b), b)
    return a + b


def test_string_permutation(spark):
    values = [f"{i:03d}" for i in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(pii.permute_string(F.lit("k"), "x", F.col("v"), (pii.DIGITS,))).collect()]
    assert sorted(got) == values
    assert got[:50] == [brute_string("k", "x", v, pii.DIGITS) for v in values[:50]]


def test_pair_permutation(spark):
    frame = spark.range(17 * 43).select((F.col("id") / 43).cast("long").alias("a"), (F.col("id") % 43).alias("b"))
    got = [(r[0].a, r[0].b) for r in frame.select(pii.permute_pair(F.lit("k"), "x", F.col("a"), F.col("b"), 17, 43)).collect()]
    assert sorted(got) == [(a, b) for a in range(17) for b in range(43)]


def test_a_plan_shows_no_key(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    assert "very secret" not in pii.pseudonymise(docs, "very secret")._jdf.queryExecution().toString()


# mixing


def test_mixing_budgets(spark):
    made = random.Random(6)
    texts = [" ".join("w" for _ in range(made.randrange(80))) for _ in range(300)] + [None, ""]
    sources = [made.choice("aaaaaabcde") for _ in range(300)] + [None, "empty"]
    got = mixing.mix(documents(spark, texts, sources)).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for source, rows in by.items():
        size, taken = sum(r.size for r in rows), sum(r.taken for r in rows)
        assert rows[0].source_size == size and abs(taken - rows[0].target) < 1 and taken <= 2 * size, source
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(documents(spark, texts, sources).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights, budget, capped = {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}, 1740.0, {}
    size = {"a": 100, "b": 1000, "c": 10, None: 50, "z": 0}
    while True:
        rest = budget - sum(capped.values())
        free = [s for s in size if s not in capped]
        shares = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > 2 * size[s]]
        if not over:
            break
        capped.update({s: 2.0 * size[s] for s in over})
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in (capped | shares).items()}


def test_apply_mix(spark):
    texts = [f"a{i}  b\nc d" for i in range(40)] + [None, ""]
    sources = ["s", "t"] * 21
    docs = documents(spark, texts, sources).withColumn("range", F.lit(1)).withColumn("size", F.lit("x"))
    taken = Counter()
    for r in mixing.apply_mix(docs).collect():
        original = texts[r.doc_id - 1]
        assert original.startswith(r.text) and r.range == 1 and r.n_chars == len(r.text)
        taken[r.doc_id] += len(r.text.split())
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken})
    assert mixing.apply_mix(documents(spark, [])).count() == 0


# pieces


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def all_paths(model, table, part):
    def go(i):
        if i == len(part):
            return [(0.0, ())]
        out = []
        for j in range(i + 1, len(part) + 1):
            if part[i:j] in table:
                piece, score = table[part[i:j]]
                out += [(score + s, (piece, *ids)) for s, ids in go(j)]
            elif j == i + 1:
                out += [(model.unknown + s, (*[model.byte_ids[b] for b in part[i].encode()], *ids)) for s, ids in go(j)]
        return out

    return sorted(go(0), key=lambda x: -x[0])


def test_n_best_equals_brute_force(model_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(lib.get_piece_size())]
    table = {lib.id_to_piece(i): (i, lib.get_score(i)) for i, s in enumerate(special) if not s}
    model, made = pieces.Pieces.load(model_path, 4), random.Random(7)
    for text in ["a", "the them", "x\n\ny  z", "日本 é", "aaaaa", " lead ", "😀b"] + ["".join(made.choice("the an ,.\nß") for _ in range(9)) for _ in range(80)]:
        want = all_paths(model, table, pieces.SPACE + text.replace(" ", pieces.SPACE))
        got = model.n_best(text)
        assert [s for s, _ in got] == [s for s, _ in want[:4]]
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
        assert {(s, tuple(i.tolist())) for s, i in got} <= set(want)
        assert all(model.decode(i) == text for _, i in got)


def test_search_is_a_star(model_path):
    model = pieces.Pieces.load(model_path, 3)
    assert [s for s, _ in model.search("▁hello")] == [s for s, _ in model.n_best("hello")]
    assert model.search("▁hello")[0] == model.of_atom("▁hello")[1::-1] or model.search("▁hello")[0][1] == model.of_atom("▁hello")[0]


class Counted(dict):
    """Counts what is looked up first in a trie: once for each place that is gone through."""

    looked = 0

    def get(self, key, default=None):
        Counted.looked += 1
        return super().get(key, default)


def test_beginnings_that_parts_share_are_gone_through_once(model_path, monkeypatch):
    made = random.Random(21)
    texts = [" ".join("".join(made.choice(("the", "an", "tion", "é", "x😀", "s")) for _ in range(made.randint(1, 4))) + made.choice(("", ",", ".")) for _ in range(60)) for _ in range(30)]
    model = pieces.Pieces.load(model_path, 1)
    model.trie, model.back, Counted.looked = Counted(model.trie), Counted(model.back), 0
    monkeypatch.setattr(pieces, "loaded", lambda path, n: (model, pieces.Speller(model)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["doc_id", "__text"])
    rows = [r for b in pieces._encoded(model_path, 1, True, ["doc_id"])(iter([batch])) for r in b.to_pylist()]
    parts = {p for t in texts for p in model.cut.findall(pieces.SPACE + t.replace(" ", pieces.SPACE))}
    assert Counted.looked == len({p[:k] for p in parts for k in range(1, len(p) + 1)})
    alone = pieces.Pieces.load(model_path, 1)
    assert [(r["score"], r["ids"]) for r in rows] == [(alone.n_best(t)[0][0], alone.n_best(t)[0][1].tolist()) for t in texts] and all(r["decoded_equal"] for r in rows)


def test_ids_are_decoded_alike_as_arrays(model_path):
    model = pieces.Pieces.load(model_path, 1)
    speller, text = pieces.Speller(model), "the and 日本 😀 é\n\x00 " * 40
    ids = model.n_best(text)[0][1]
    assert len(ids) > pieces.MANY_IDS and speller.raw(ids) == b"".join(speller[i] for i in ids.tolist()) and speller.text(ids) == text


def test_parts_in_order_give_what_a_star_gives_alone(model_path):
    model, made = pieces.Pieces.load(model_path, 2), random.Random(22)
    parts = sorted({"▁" * made.randint(0, 2) + "".join(made.choice(["the", "an", "é", "ß", "日", "😀", ".", "a", "\ud800"]) for _ in range(made.randint(1, 9))) for _ in range(400)})
    for part, (ids, score, loss) in zip(parts, model.of_parts(parts), strict=True):
        found = model.search(part)
        assert (score, ids) == found[0] and loss == (score - found[1][0] if len(found) > 1 else float("inf"))


def test_encode_query_shape(spark, model_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = pieces.encode_n_best(docs, model_path).collect()
    for i, t in enumerate(ODD):
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and all(r.decoded_equal for r in rows)
        assert rows[0].score == max(r.score for r in rows) and (rows[0].n_pieces == 0) == (not t)
        assert all(zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_pieces for r in rows)
    assert pieces.encode_n_best(docs.limit(0), model_path).count() == 0


def test_query_returns_the_ids(spark, small):
    got = entry.op2_sentencepiece(spark, small).where("doc_id < 5").collect()
    assert got and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in got)


# WARC


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_archives(spark, segment):
    html = [None, "", "<p>é</p>" * 50, "<p>é</p>" * 50, "x" * 9000, "a\r\n\r\nWARC/1.1\r\n", "x" * 9000, "0\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, h) for i, h in enumerate(html)] + [(7, "u", html[7])], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_and_read(pages.withColumn("sha", F.lit("x")), segment_bytes=segment).collect()), key=str)
    want = []
    for i, h in [*enumerate(html), (7, html[7])]:
        payload = (h or "").encode()
        first = min(k for k, o in enumerate(html) if (o or "") == (h or ""))
        want.append((i, len(payload), warc.payload_digest(payload), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_minimum_for_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_and_read(pages, min_revisit_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_reader_refuses_damage():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    assert warc.http_payload(block) == b"hello world"
    assert warc.dechunked(b"5;x=1\r\nhello\r\n0\r\nT: 1\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nhello\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse_records(__import__("gzip").compress(b"junk\r\n\r\n")))
    import pyarrow as pa

    parts = [r for r in warc.page_records(1, "u", "z" * 300, None, False, 100)]
    parsed = [next(warc.parse_records(__import__("gzip").compress(p))) for p in parts]
    rows = [{"origin": "o", "number": int(h["warc-segment-number"]), "total": int(h.get("warc-segment-total-length", 0)) or None, "headers": list(h.items()), "block": b} for h, b in parsed]
    kind = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    random.Random(8).shuffle(rows)
    assert warc._reassembled(pa.Table.from_pylist(rows, kind)).to_pylist()[0]["payload_bytes"] == 300
    last = max(r["number"] for r in rows)
    for missing in ([r for r in rows if r["number"] != 2], [r for r in rows if r["number"] != last]):
        with pytest.raises(ValueError):
            warc._reassembled(pa.Table.from_pylist(missing, kind))


# cover tree


def test_top_k_equals_brute_force(spark):
    made = np.random.default_rng(9)
    centres = made.normal(0, 2, (6, 8))
    vectors = [(int(i), (centres[i % 6] + made.normal(0, 0.05, 8)).tolist()) for i in range(400)] + [(400, [1.0] * 8), (401, [1.0] * 8), (402, [1.0] * 8)]
    vectors += [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [1.0, 2.0]), (None, [1.0] * 8), (400, [1.0] * 8), (750, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = {}
    for r in cover_tree.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors[:403]}
    for q in (i for i in usable if i % 50 == 0):
        best = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q))[:5]
        assert sorted(got.pop(q)) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == {}


def test_search_prunes():
    made = np.random.default_rng(10)
    centres = made.normal(0, 300, (12, 16))
    points = np.floor(centres[np.arange(3000) % 12] + made.normal(0, 4, (3000, 16)))
    ids = np.arange(3000)
    stacked, all_ids = np.r_[points[:60], points], np.r_[ids[:60], ids]
    seen = []
    plain = np.ndarray.__matmul__
    root = cover_tree.build(stacked, 60)
    leaves, stack = 0, [root]
    while stack:
        x = stack.pop()
        leaves += not x.children
        stack += x.children
        assert np.all(cover_tree.distances(stacked[np.r_[x.queries, x.data]], x.centre) <= x.radius + 1e-6)
    assert leaves >= 12 and not seen and plain
    scores, found = cover_tree.search(stacked, all_ids, 60, 5)
    product = points[:60] @ points.T
    product[np.arange(60), np.arange(60)] = -np.inf
    for q in range(60):
        want = np.lexsort((ids, -product[q]))[:5]
        assert found[q].tolist() == want.tolist() and scores[q].tolist() == product[q][want].tolist()


def test_large_numbers_are_exact():
    points = np.array([[2.0**30, 1.0], [2.0**30, 3.0], [2.0**30 - 1, 5.0]])
    scores, found = cover_tree.search(points, np.array([1, 2, 3]), 1, 2)
    assert found.tolist() == [[2, 3]] and scores[0, 0] == 2**60 + 3


# URL lists


def test_temporal_lists(spark):
    captures = [(1, "http://a.b.example.com/x", 5), (2, "HTTPS://u:p@A.b.Example.com:80/", 10), (3, "http://b.example.com", 15), (4, "http://xb.example.com", 15), (5, None, 15), (6, "nonsense", 15), (7, "http://b.example.com", None), (8, "http://a.b.example.com.", 25), (9, "http://b.example.com", 20), (1, "http://a.b.example.com/x", 5)]
    entries = [("b.example.com", "add", 10), ("b.example.com", "remove", 20), ("b.example.com", "add", 20), ("b.example.com", "remove", 24), ("A.b.example.com", "add", 12), (None, "add", 1), ("example.com", "add", None)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("pattern2", F.lit(1))
    got = [(r.page_id, r.pattern, r.listed_since, r.blocked) for r in url_lists.listed(frame, spark.createDataFrame(entries, "pattern string, action string, at long")).orderBy("page_id").collect()]
    assert got == [
        (1, None, None, False), (1, None, None, False), (2, "b.example.com", 10, True), (3, "b.example.com", 10, True), (4, None, None, False), (5, None, None, False), (6, None, None, False),
        (7, None, None, False), (8, "a.b.example.com", 12, True), (9, "b.example.com", 20, True),
    ]
    none = spark.createDataFrame([], "pattern string, action string, at long")
    assert url_lists.listed(frame, none).where("blocked").count() == 0
    assert url_lists.listed(frame.limit(0), none).count() == 0


def test_a_listed_top_level_domain(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", 5), (2, "http://b.org", 5), (3, "http://com", 5)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("com", "add", 1), ("a.b.com", "add", 6)], "pattern string, action string, at long")
    assert sorted((r.page_id, r.pattern) for r in url_lists.listed(captures, entries).where("blocked").collect()) == [(1, "com"), (3, "com")]


# token files


def test_token_files_equal_the_library(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = ODD + ["it's, SHE'LL. Straße ÉTÉ İx ΟΔΟΣ <|endoftext|> <|ENDOFTEXT|>", "a,,b ..! 's 12,5 x's, ½ µm", "ﬁ Ａ é K ́x"]
    docs = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)] + [(None, "null id"), (20, "a repeated id")], "doc_id long, text string").withColumn("range", F.lit(1))
    got = sorted(map(tuple, token_files.encode_and_read(docs, path, 49408).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    rows = sorted(((i is not None, i, t is not None, t or "") for i, t in [(i * 10, t) for i, t in enumerate(texts)] + [(None, "null id"), (20, "a repeated id")]), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
    start, want = 0, []
    for _, i, _, t in rows:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.encode_and_read(docs.limit(0), path, 49408).count() == 0


def test_frames(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    docs = [(i, np.arange(i % 40, dtype="<u2").tobytes()) for i in range(100)] + [(None, b"")]
    data = token_files.pack_file(docs, 2) + (0x8F92EAB1).to_bytes(4, "little")
    f = token_files.TokenFile(data)
    assert [(i, x.tobytes()) for i, x in f] == docs and len(f.table) > 20
    assert f.document(57).tobytes() == docs[57][1]
    import io

    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(x for _, x in docs)
    broken = bytearray(data)
    broken[int(f.offsets[3]) + 12] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFile(bytes(broken)))
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:-1])


# classifier


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = entry.op9_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())


def test_odd_texts_get_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(3, None)], "doc_id long, quality int")
    got = classifier.score_quality(docs, labels).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.score_quality(docs.limit(0), labels).count() == 0


def test_oracles_run(small):
    assert len(oracle(entry.OP10_SQL, small)) == 200


def test_sets_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_BITS", 3)
    made = random.Random(13)
    texts = []
    for k in range(12):
        base = [f"n{k}_{i}" for i in range(40)]
        texts += [edited(base, made, e) for e in (0, 0, 1, 3)]
    ids = list(range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts, ids=ids)).collect()}
    assert got == dict(zip(ids, brute_components(texts, ids), strict=True))


def test_n_best_of_ties_and_of_a_long_part():
    table = {"a": (0, -1.0), "aa": (1, -2.0), "aaa": (2, -3.0), "b": (3, -0.3), "ab": (4, -1.3), "▁": (5, -1.0)}
    model = pieces.Pieces(table, list(range(100, 356)), 5)
    for text in ("aaaaa", "aabab", "x", "aaaaaaaa", "baaab"):
        want = all_paths(model, {p: (i, round(s * pieces.GRID) / pieces.GRID) for p, (i, s) in table.items()}, text)
        names = {i: p for p, (i, _) in table.items()}
        longest_last = lambda x: (-x[0], [-len(names.get(i, "x")) for i in reversed(x[1])])  # noqa: E731, B023
        assert [(s, tuple(np.frombuffer(i, "<i4").tolist())) for s, i in model.search(text)] == sorted(want, key=longest_last)[:5]
        ids, score, loss = model.of_part(text)
        found = model.search(text)
        assert (score, ids) == found[0] and loss == (score - found[1][0] if len(found) > 1 else float("inf"))
    found = model.search("a" * 50_000)
    assert len(found) == 5 and {s for s, _ in found} == {-50_000.0}


def test_names_of_the_result_are_refused(spark, model_path):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, RANK string")
    with pytest.raises(ValueError, match="rank"):
        pieces.encode_n_best(docs, model_path, keep=("doc_id", "RANK"))
    assert pieces.encode_n_best(docs, model_path, keep=("doc_id", "text")).first().text == "a b"


def test_recent_results_are_bounded():
    from veilframe.llm.common import Recent

    made = []
    kept = Recent(lambda k: made.append(k) or len(k), 20_000, 100)
    for i in range(1000):
        assert kept[f"k{i}"] == len(f"k{i}") and kept["often"] == 5
    assert kept["x" * 300] == 300 and "x" * 300 not in kept
    assert made.count("often") == 1 and len(kept) + len(kept.older) < 200


def test_a_long_chunk_is_not_kept(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    known = token_files.ChunkIds(path, "<u2")
    texts = ["z" * 5000 + " it, it. it 12", "word, " * 50]
    plain = [np.asarray(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert known.texts(texts) == plain and max(map(len, known)) <= token_files.LONGEST
    known.held = token_files.KEPT_BYTES
    assert known.texts(texts[::-1]) == plain[::-1] and known.older


def test_clean_keeps_own_columns(spark):
    texts = [own(i) + "\nsame line here" for i in range(12)]
    own_names = {c: F.lit(999) for c in ("N_words", "word_chars", "n_removed_words", "over_lines", "kept", "__text", "__host", "host", "line", "w")}
    docs = documents(spark, texts).withColumns(own_names)
    got = quality_rules.clean(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert r.text == own(r.doc_id - 1) and all(r[c] == 999 for c in own_names)
    assert {r.n_words for r in quality_rules.judge(docs).collect()} == {39}


def test_stage_of_pseudonyms_keeps_own_columns(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, ["mail me@x.com", None]).withColumn("n_ip", F.lit("own"))
    got = corpus_pipeline.private(spark, docs, small)
    assert got.columns == docs.columns and [r.n_ip for r in got.collect()] == ["own", "own"]


def test_archives_of_others(spark, tmp_path):
    import gzip

    digest = warc.payload_digest(b"hello")
    http = [("Content-Type", "application/http; msgtype=response")]
    made = [
        warc.record("warcinfo", [("WARC-Record-ID", "<urn:i>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        warc.record("request", [("WARC-Record-ID", "<urn:q>"), *http], b"GET / HTTP/1.1\r\n\r\n"),
        warc.record("revisit", [("WARC-Record-ID", "<urn:v>"), ("WARC-Refers-To", "<urn:r>"), ("WARC-Payload-Digest", f"sha1:{digest}"), *http], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        warc.record("response", [("WARC-Record-ID", "<urn:r>"), ("WARC-Target-URI", "http://h/"), *http], b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"),
        warc.record("revisit", [("WARC-Record-ID", "<urn:w>"), ("WARC-Refers-To", "<urn:none>"), ("WARC-Payload-Digest", f"sha1:{digest}"), *http], b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n"),
        warc.record("metadata", [("WARC-Record-ID", "<urn:m>")], b"fetchTimeMs: 3\r\n"),
        warc.record("response", [("WARC-Record-ID", "<urn:d>"), ("WARC-Payload-Digest", "sha256:00"), ("Content-Type", "text/dns")], b"plain"),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    got = {tuple(r) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    plain = warc.payload_digest(b"plain")
    assert got == {(None, 5, digest, "response", None), (None, 5, digest, "revisit", None), (None, 7, digest, "revisit", None), (None, 5, plain, "response", None)}
    assert {r.record_id: r.refers_to_id for r in warc.read_records(spark, str(tmp_path / "a")).collect()} == {"<urn:r>": None, "<urn:v>": "<urn:r>", "<urn:w>": "<urn:none>", "<urn:d>": None}
    (tmp_path / "b").mkdir()
    wrong = warc.record("revisit", [("WARC-Record-ID", "<urn:v>"), ("WARC-Refers-To", "<urn:r>"), ("WARC-Payload-Digest", f"sha1:{plain}"), *http], b"HTTP/1.1 200 OK\r\n\r\n")
    (tmp_path / "b/two.warc.gz").write_bytes(gzip.compress(made[3]) + gzip.compress(wrong))
    with pytest.raises(Exception, match="digest of a revisit"):
        warc.read_archives(spark, str(tmp_path / "b")).collect()


def test_addresses_and_own_columns_of_captures(spark):
    urls = ["http://10.20.30.40/x", "http://[2001:DB8::1]:80/", "http://30.40/", "http://u@[::1]/"]
    captures = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, fetched_at long").withColumns({"host": F.lit("own"), "Pattern": F.lit(1), "salt": F.lit(2), "t": F.lit(3)})
    entries = spark.createDataFrame([("30.40", "add", 1), ("40", "add", 1), ("[2001:db8::1]", "add", 1), ("[", "add", 1)], "pattern string, action string, at long")
    got = {r.page_id: (r.host, r.pattern, r.salt, r.t) for r in url_lists.listed(captures, entries).collect()}
    assert got == {0: ("10.20.30.40", None, 2, 3), 1: ("[2001:db8::1]", "[2001:db8::1]", 2, 3), 2: ("30.40", "30.40", 2, 3), 3: ("[::1]", None, 2, 3)}


def test_hot_patterns_are_salted(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "SALT_ROWS", 7)
    made = random.Random(14)
    captures = [(i, f"http://h{made.randrange(5)}.a.com/", made.randrange(60)) for i in range(300)]
    entries = [(made.choice(["com", "a.com", "h1.a.com"]), made.choice(["add", "remove"]), made.randrange(60)) for _ in range(60)]
    got = {r.page_id: (r.pattern, r.listed_since) for r in url_lists.listed(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "pattern string, action string, at long")).collect()}
    for i, url, t in captures:
        host, best = url[7:-1], (None, None)
        for p in ("com", "a.com", host):
            past = [e[2] for e in entries if e[0] == p and e[2] <= t]
            if past and any(e[0] == p and e[2] == max(past) and e[1] == "add" for e in entries):
                best = (p, max(past))
        assert got[i] == best


def test_learning_is_bounded_and_repeats(spark):
    texts = ["plain words of a text " * 5, "BUY!!! now $$$ " * 9] * 20
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(4)], "doc_id long, quality int")
    one = sorted((r.doc_id, r.score) for r in classifier.score_quality(docs, labels, train_rows=8).collect())
    assert one == sorted((r.doc_id, r.score) for r in classifier.score_quality(docs.repartition(3), labels, train_rows=8).collect())


def test_plain_version_of_the_classifier(spark):
    texts = ["One two TWO two, 3", "two three. Three one", None, "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vectors = classifier.word_vectors(docs)
    places, signs = classifier.index_vectors()
    want = np.zeros((classifier.BUCKETS + classifier.MARKERS, classifier.WIDTH))
    rows = []
    for t in texts:
        tokens = (t or "").split()
        codes = [classifier.token_code(x.encode()) for x in tokens]
        buckets = [c >> 8 & 0xFFFF for c in codes]
        marks = [(192 + (c & 31) if i and tokens[i] == tokens[i - 1] else c & 0xFF) + classifier.BUCKETS for i, c in enumerate(codes)]
        rows.append((buckets, marks))
        pairs = [(m, b) for b, m in zip(buckets, marks, strict=True)]
        for i in range(len(tokens)):
            for j in range(max(0, i - classifier.WINDOW), min(len(tokens), i + classifier.WINDOW + 1)):
                if i != j:
                    pairs += [(buckets[i], buckets[j]), (marks[i], marks[j])]
        for a, b in pairs:
            for place, sign in zip(places[b], signs[b], strict=True):
                want[a, place] += sign
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norms, out=np.zeros_like(want), where=norms > 0)
    assert np.allclose(vectors, want, atol=1e-6)
    x = classifier.pooled(texts, vectors, classifier.known_tokens())
    for row, (buckets, marks) in zip(x, rows, strict=True):
        mean = lambda at: vectors[at].mean(axis=0) if at else np.zeros(classifier.WIDTH)
        assert np.allclose(row, np.r_[mean(buckets), mean(marks), np.log1p(len(buckets))], atol=1e-6)
    made = np.random.default_rng(15)
    a, y = made.normal(0, 1, (300, 4)), None
    y = (a[:, 0] + 0.3 * made.normal(0, 1, 300) > 0).astype(float)
    net = classifier.Network(4).fit(a, y)
    for i in range(5):
        hidden = [np.tanh(sum((a[i, k] - net.mean[k]) / net.scale[k] * net.w1[k, h] for k in range(4)) + net.b1[h]) for h in range(classifier.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert abs(net.scores(a[i : i + 1])[0] - 1 / (1 + np.exp(-logit))) < 1e-9
    assert ((net.scores(a) > 0.5) == (y == 1)).mean() > 0.85
