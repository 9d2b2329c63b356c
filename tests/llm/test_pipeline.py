"""The corpus pipeline against a plain version of every stage, on a small made-up table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_operators import DOCS, brute_components, brute_rules, brute_string

from veilframe.llm import pieces, quality_rules
from veilframe.llm.entry import PII_KEY


def plain_quality(rows):
    norm = lambda line: " ".join(x.decode() for x in line.encode().split()).lower()
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in rows:
        texts[source].add(text or "")
        for line in filter(None, map(norm, (text or "").split("\n"))):
            holders[source, line].add(text)
    over = {k for k, held in holders.items() if len(held) > max(quality_rules.MIN_DOCUMENTS, quality_rules.MAX_SHARE * len(texts[k[0]]))}
    out = []
    for doc_id, text, lang, source, n in rows:
        n_words, _, _, _, n_repeat = brute_rules(text)
        lines = (text or "").split("\n")
        gone = sum(len(norm(x).split(" ")) for x in lines if (source, norm(x)) in over)
        if n_words < 20 or 100 * n_repeat > 30 * n_words or gone > quality_rules.MAX_REMOVED * n_words:
            continue
        kept = "\n".join(x for x in lines if (source, norm(x)) not in over)
        out.append((doc_id, kept, lang, source, len(kept) if gone else n))
    return out


def plain_near_duplicates(rows):
    found = brute_components([r[1] for r in rows], [r[0] for r in rows])
    return [r for r, (_, c) in zip(rows, found, strict=True) if r[0] == c]


def plain_pii(rows):
    def ssn(m):
        digits = iter(brute_string(PII_KEY, "ssn", m[0].replace("-", ""), "0123456789"))
        return "".join(next(digits) if c.isdigit() else c for c in m[0])

    def secret(m):
        return m[1] + brute_string(PII_KEY, "secret", m[2], "0123456789abcdef")

    out = []
    for doc_id, text, lang, source, _ in rows:
        new = re.sub(r'(token = ")([0-9a-f]{40})', secret, re.sub(r"\d{3}-\d{2}-\d{4}", ssn, text))
        out.append((doc_id, new, lang, source, len(new)))
    return out


def plain_mix(rows):
    size = {r[0]: len(r[1].split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[r[0]] for r in by[s]) for s in order}
    budget, capped = 1.5 * sum(total.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * total[s]]
        if not over:
            break
        capped |= {s: 2.0 * total[s] for s in over}
    out = []
    for s in order:
        left = int(capped.get(s, level * weight[s]))
        epochs, rest = divmod(left, total[s])
        keyed = sorted(by[s], key=lambda r: int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:15], 16))
        for r in keyed:
            part = min(size[r[0]], rest)
            rest -= part
            taken = epochs * size[r[0]] + part
            whole, cut = divmod(taken, size[r[0]])
            out += [r[:4]] * whole
            if cut:
                spaced = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])
                out.append((r[0], "".join(spaced[:cut]), r[2], r[3]))
    return out


def test_run_equals_the_plain_version(spark, tmp_path):
    made = random.Random(11)
    word = lambda: made.choice("able baker charlie dog easy fox george how item jig".split()) + str(made.randrange(900))
    rows = []
    for i in range(90):
        text = "\n".join(" ".join(word() for _ in range(14)) for _ in range(made.randrange(2, 5)))
        if i % 3 == 0:
            text += "\nSubscribe  to OUR letter"
        if i % 10 == 4:
            text += f" id {made.randrange(100, 600)}-12-{made.randrange(1000, 9000)} token = \"{made.getrandbits(160):040x}\" end"
        rows.append([i, text, "en", f"s{made.choice((0, 0, 0, 1, 2, 3))}", len(text)])
    rows += [[100 + i, rows[i][1] + " more", "en", "s0", 5] for i in range(8)] + [[200, "too short", "en", "s1", 9], [201, None, "en", "s1", None], [202, "again and again " * 40, "en", "s2", 600]]
    rows = [tuple(r) for r in rows]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(str(tmp_path / "sf/documents.parquet"))
    want = plain_mix(plain_pii(plain_near_duplicates(plain_quality(rows))))
    model = pieces.Pieces.load(corpus_pipeline.MODEL)
    expected = Counter()
    for doc_id, text, _, source in want:
        expected.update((doc_id, source, rank, score, tuple(ids.tolist())) for rank, (score, ids) in enumerate(model.n_best(text), 1))
    got = Counter((r.doc_id, r.source, r.rank, r.score, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect())
    assert got == expected and len(want) > 60


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "pii", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


@pytest.mark.parametrize("place", range(5))
def test_stages_take_no_rows(spark, small, place):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[place][1](spark, empty, small).count() == 0
