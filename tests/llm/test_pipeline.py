"""run() of the corpus pipeline against a plain Python version of its five stages, on a fixture with every kind of case; empty and null tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int, per_line: int = 12) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]).capitalize() + "." for i in range(0, words, per_line))


def cleaned(text):
    """Text after the quality rules, or None."""
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    left = []
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        marks = len(re.findall(r"[#*$%&|<>]", line)) + len(re.findall(r"[!?]{2,}", line))
        bare = 4 <= n <= 16 and not re.search(r"[.!?:;]\s*$", line)
        menu = len(re.findall(r"(?:^| )[|»›>•·](?= |$)", line)) >= 3
        phrase = n <= 12 and re.search(r"(?i)\b(all rights reserved|read more)\b", line)
        if not (n and (marks >= 0.3 * n or bare or menu or phrase)):
            left.append(line)
    size = lambda lines: sum(len(w) for x in lines for w in WORD.findall(x))
    whole = size(text.split("\n"))
    return "\n".join(left) if whole - size(left) <= 0.4 * whole else None


def without_later_runs(docs):
    """Every run of lines of 50 words or more that stands earlier too is cut; docs in order of id."""
    lines = {i: t.split("\n") for i, t in sorted(docs.items())}
    at, gone = [(i, k) for i in lines for k in range(len(lines[i]))], set()
    for a, (i, k) in enumerate(at):
        for j, m in at[a + 1 :]:
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n] and ((i, k + n) < (j, m)):
                n += 1
            if sum(len(WORD.findall(x)) for x in lines[j][m : m + n]) >= 50:
                gone |= {(j, m + x) for x in range(n)}
    return {i: "\n".join(x for k, x in enumerate(own) if (i, k) not in gone) for i, own in lines.items()}


def one_of_each(docs):
    sets = {}
    for i, t in docs.items():
        words = [w.lower() for w in WORD.findall(t)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if root(i) == i}


def copies(docs, source):
    size = {i: len(WORD.findall(t)) for i, t in docs.items()}
    names = sorted({source[i] for i in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in docs if source[i] == s) for s in names}
    target, open_, rest = {}, dict(zip(names, [1, 2, 3] * len(names))), sum(total.values())
    while open_:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 3 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            rest -= target[s]
            del open_[s]
    out = {}
    for s in names:
        digest = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
        order = sorted((i for i in docs if source[i] == s and size[i]), key=lambda i: (math.floor(math.log2(size[i]) * 4), digest(str(i), 8), i))
        offset, rate = digest(f"{s or ''}|7", 5) / (1 << 20), target[s] / total[s] if total[s] else 0.0
        out |= {i: math.floor(rate * k + offset) - math.floor(rate * (k - 1) + offset) for k, i in enumerate(order, 1)}
    return out


def brute(rows):
    source = {r[0]: r[3] for r in rows}
    docs = {i: c for i, t, *_ in rows if (c := cleaned(t)) is not None}
    docs = one_of_each(without_later_runs(docs))
    known, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, n in copies(docs, source).items():
        ids = known.encode(docs[i], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out += [(i, len(ids), sha(",".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False)))] * n
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    passage, base = prose(1, 72), prose(2, 160)
    texts = [prose(100 + i, 60 + 17 * i) for i in range(14)]
    texts += [prose(30, 90) + "\n" + passage, passage + "\n" + prose(31, 70), prose(32, 60) + "\n" + passage + "\n" + prose(33, 60)]
    texts += [base, base.replace(base.split()[70], "changed", 1), base, base + "\nAnd one more line of words here."]
    texts += [prose(40, 120) + "\nHome | News | About | Contact\nAll rights reserved.", prose(41, 60) + "\n" + "\n".join("Aaa### bbb$$$ ccc%%% ddd&&&" for _ in range(30)), "too short", None, "", "the same " * 90]
    texts += [prose(50, 700).replace("\n", " ") + " read more " + prose(51, 30).replace("\n", " ")]
    return [(3 * i + 1, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]


def test_run_equals_plain_python(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(want) > 15 and got == want


def test_run_on_empty_and_null_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    text = prose(9, 100)
    odd = [(None, None, None, None, None), (None, text, None, None, None), (None, text, None, None, None), (5, prose(10, 90), None, "s", 1), (5, prose(10, 90), None, "s", 1)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} <= {None, 5} and len({r.ids_sha256 for r in got}) <= 2
