"""Alignment, fertility and lexical search against plain loops over the libraries, with their edge rows."""
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from tidemark.llm import alignment, fertility, lexical_search, vocabularies

A, B, MULTI = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, " \n\t"), (5, "long é " * 20_000), (6, "x" * 50_000), (7, "<|endoftext|> it's İ ﬁ 'LL ▁ \x00"),
         (8, "<s> <0x41> 漢字 🙂"), (9, "a▁b"), (10, "a"), (11, "  two  spaces  ")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def test_byte_vocabulary_is_its_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    mine = vocabularies.byte_vocabulary(A)
    assert mine.plain
    rng = random.Random(1)
    texts = [f"a{c} 1{c} {c}{c}!{c}  {c}\n" for c in map(chr, [*range(0x250), *range(0x2000, 0x2100), *rng.sample(range(0x250, 0xD800), 2000)])]
    texts += ["".join(rng.choice("ab'sdtlmvre 1²½\n\t \x85\xa0é!<|endoftext|>.,") for _ in range(30)) for _ in range(3000)]
    assert all(mine.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def plain_alignment(rows):
    """Per row the contract's columns, by loops over all tokens with both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    byte_of = vocabularies._byte_of()
    found, counts = [], Counter()
    for _, text in rows:
        links, groups = [], []
        ids_a = ids_b = ()
        if text:
            ids_a, ids_b = ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            a = [bytes(byte_of[c] for c in ta.id_to_token(i)) for i in ids_a]
            b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                ends_a, ends_b = list(np.cumsum([len(x) for x in a])), list(np.cumsum([len(x) for x in b]))
                links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in ends_a if e in set(ends_b)]
                cuts = [e for e in ends_a if e in set(ends_b)]
                for low, high in zip([0, *cuts], cuts):
                    groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= high))
            else:
                ids_a = ids_b = ()
        counts.update(links)
        found.append((len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(key, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
            for (key, _), (na, nb, g, ls) in zip(rows, found)]


def test_alignment_against_loops(spark, docs):
    rng = random.Random(5)
    words = ["the", "alignment", "naïve", "漢字", "x" * 40, "1234", "  ", "\n", "ﬁn", "é", "'s"]
    short = [r for r in EDGES if len(r[1] or "") < 1000]
    rows = short + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)]
    rows += rows[-5:] + [(900 + i, rows[-1][1]) for i in range(30)]  # a group of copies
    columns = ["doc_id", *alignment.MEASURES, "groups_sha256"]
    got = sorted((tuple(r) for r in alignment.alignment(docs(rows), A, B).select(columns).collect()), key=repr)
    assert got == sorted(plain_alignment(rows), key=repr)
    assert alignment.alignment(docs([]), A, B).collect() == []
    long = {r.doc_id: r for r in alignment.alignment(docs(EDGES), A, B).collect()}
    assert long[5].n_a > 20_000 and long[9].n_a == 0 and long[9].groups_sha256 == "" and long[1].n_links == 0


def test_links_are_possible_pairs():
    known, size = alignment.possible_pairs(A, B), len(vocabularies.piece_vocabulary(B).bytes)
    a, b = vocabularies.byte_vocabulary(A), vocabularies.piece_vocabulary(B)
    rng = random.Random(2)
    for n in rng.sample(range(len(known)), 2000):
        x, y = a.bytes[known[n] // size], b.bytes[known[n] % size]
        assert x.endswith(y) or y.endswith(x)
    assert len(known) < sum(a.length) + sum(b.length) * 2  # a token has no more suffixes than bytes


def plain_base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_base_rules_and_edges(spark, docs):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\x0b", "#", "|", "🙂"]) for _ in range(rng.randint(0, 400)))) for i in range(100)]
    rows += [(300, "same line\nsame line\nother\n \n \nsame line"), (301, "a b c a b c"), (302, "a b c d a b c"), (302, "a b c d a b c")]
    out = fertility.quality(docs(rows), B, MULTI)
    got = sorted(((r.doc_id, *(r[c] for c in fertility.BASE), r.base_failed) for r in out.collect()), key=repr)
    assert got == sorted(((key, *plain_base(t)) for key, t in rows), key=repr)
    assert fertility.quality(docs([]), B, MULTI).collect() == []
    assert "lang" not in out.columns and not any(r.kept for r in out.where("base_failed").collect())


def test_quality_bands(spark, docs):
    """Per language the measures follow the libraries, and what does not fit its language is rejected, also under a null language."""
    rng = random.Random(8)
    vocab = {"en": "people water small house should between number because almost river letter market".split(),
             "el": "θάλασσα σπίτι άνθρωπος μικρός γράμμα ποτάμι αγορά αριθμός".split()}
    prose = lambda lang, n=120: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    rows = [(i, prose("en"), "en") for i in range(60)] + [(100 + i, prose("el"), "el" if i % 2 else None) for i in range(80)]
    rows += [(i, rows[0][1], "en") for i in range(200, 400)]  # copies do not narrow the band
    junk = {500: (prose("en").replace(" ", "&&& "), "en"), 501: (" ".join("%02x" % rng.randrange(256) * 6 for _ in range(120)), "en"),
            502: (" ".join("".join(chr(rng.randrange(0x10000, 0x10400)) for _ in range(5)) for _ in range(100)), None)}
    rows += [(k, *v) for k, v in junk.items()]
    out = {r.doc_id: r for r in fertility.quality(docs(rows), B, MULTI).collect()}
    assert [k for k, r in out.items() if not r.kept and not r.base_failed and k not in junk] == []
    assert not out[500].kept and not out[501].kept and out[500].rejected_by
    assert out[502].kept or out[502].base_failed  # a script seen once has no band
    piece, byte = vocabularies.piece_vocabulary(B), vocabularies.byte_vocabulary(MULTI)
    for key, text, _ in rows[:3]:
        chars, ids = sum(map(len, text.split())), piece.encode(text)
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert out[key].piece_fertility == chars / len(ids) and out[key].byte_fertility == chars / len(byte.encode(text))
        assert math.isclose(out[key].piece_entropy, -(share * np.log2(share)).sum() / math.log2(len(ids)), rel_tol=1e-12)
        assert out[key].fallback_share == sum(bool(piece.is_byte[i]) for i in ids) / len(ids)


def test_scripts():
    for text, want in [("", "none"), ("12 !", "none"), ("abc é", "latin"), ("Привет a", "cyrillic"), ("漢字かな", "kana"), ("漢字漢字", "han"), ("한국어", "hangul")]:
        assert fertility.script_of(text) == want


def plain_search(docs, items, top=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = [(key, Counter(TERM.findall(lower(t)))) for key, t in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lower(text)))
        scored = []
        for key, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-s, key is None, key or 0, key)] if s > 0 else []
        out += [(item, k + 1, key, -s) for k, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes, bucket", [(4 << 20, 2048), (400, 7)])
def test_search_against_loops(spark, docs, part_bytes, bucket):
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÄRGER", "ärger", "x1", "the", "a_b", "naïve", *[f"w{i}" for i in range(200)]]
    weight = [1 / (1 + k) for k in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weight, k=n))
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(7, "alpha w3"), (50, None), (51, " !"), (52, "unknownword"), (None, "beta")]
    rows = EDGES + [(100 + i, text(rng.randint(1, 200))) for i in range(150)] + [(400 + i, text(5) + " " + items[3][1]) for i in range(4)]
    rows += [(600 + i, items[5][1]) for i in range(15)] + [(100, text(20)), (None, items[4][1])]  # ties, a repeated and a null id
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.ranked(docs(rows), asked, part_bytes=part_bytes, bucket=bucket)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, items)
    assert lexical_search.ranked(docs([]), asked).collect() == [] and lexical_search.ranked(docs(rows), asked.limit(0)).collect() == []


def test_bounds_never_lose_a_vector():
    rng = np.random.default_rng(6)
    weight = rng.integers(1, 9000, 60)
    first = np.concatenate([[0], np.cumsum(rng.integers(1, 30, 300))])
    held = np.concatenate([np.sort(rng.choice(60, b - a, replace=False)) for a, b in zip(first, first[1:])])
    impact = rng.integers(1, 900_000, len(held))
    length = np.sqrt(np.add.reduceat(weight[held] * impact.astype(float) ** 2, first[:-1]))
    b = lexical_search.Bucket(list(range(300)), length, held, impact, first, weight)
    for _ in range(40):
        terms = rng.choice(60, 20, replace=False)
        mask = np.isin(np.arange(60), terms)
        score = b.scores(np.arange(300), mask)
        least = int(np.sort(score)[-10])
        assert score.tolist() == [int((weight[held[x:y]] * impact[x:y])[mask[held[x:y]]].sum()) for x, y in zip(first, first[1:])]
        heavy, light = terms[:8], terms[8:]
        kept = b.survivors(heavy, float(np.sqrt(weight[light].sum())), least)
        assert set(np.flatnonzero(score >= least)) <= set(kept) and len(kept) < 300
        assert np.sqrt(weight[terms].sum()) * length.max() * (1 + 1e-9) >= score.max()


@needs_data
def test_registered_queries_on_the_small_tables(spark):
    queries = entry.queries()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries["op13_lexical_search"](spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items)
    got = queries["op12_quality_rules"](spark, SF)
    assert got.columns[:8] == ["doc_id", *fertility.BASE, "base_failed", "kept"]
    assert sorted((r.doc_id, *(r[c] for c in fertility.BASE), r.base_failed) for r in got.collect()) == sorted((k, *plain_base(t)) for k, t in docs)
    got = queries["op11_token_alignment"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in alignment.MEASURES], ("groups_sha256", "string")]
    few = [(k, (t or "")[:3000]) for k, t in docs[:60]]
    cut = alignment.alignment(spark.createDataFrame(few, "doc_id long, text string"), A, B)
    assert sorted(tuple(r) for r in cut.collect()) == sorted(plain_alignment(few))
    assert got.count() == len(docs)
