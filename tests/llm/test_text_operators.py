"""Personal data, languages, pages, tokens, benchmark passages and mixing, with their edge cases."""
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import decontamination, html_extract, language_id, mixing, pii, token_counts, token_files

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, " \n\t"), (5, "long é " * 40_000), (6, "x" * 90_000), (7, "<|endoftext|> it's İ ﬁ Σας á 'LL ▁ \x00"), (8, "12 34")]


@pytest.fixture(scope="module")
def field():
    return pii.train(pii._labelled())


def test_patterns_against_plain_regexes():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab0123456789 @.+-()%") if rng.random() < 0.9 else rng.choice(["4111 1111 1111 1111", "1.2.3.4", "@a.b", "+1 ("]) for _ in range(rng.randint(0, 60)))
        want = []
        for n, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                digits = re.sub(r"\D", "", m[0])
                if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                    continue
                want.append((m.start(), n, m.end(), kind))
        assert pii.base_spans(text) == [(a, b, k) for a, _, b, k in sorted(want)], text


def test_long_runs_of_digits_and_long_words(field):
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.1.1.1") == [(0, 5007, "ip")] and pii.base_spans("1.1.1." + zeros + "256") == []
    assert pii.plausible(zeros + "1.2.3.4", "ip") and not pii.plausible("9" * 6000 + ".2.3.4", "ip")
    assert pii.learned_spans([zeros + "1.1.1.1 " + "1" * 9000 + " " + "a@" * 4000], field) is not None
    assert pii.shape("a1" * 200 + "@") != pii.shape("a1" * 200 + "#")


def test_field_adds_other_forms_and_leaves_clean_text(field):
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.learned_spans([t], field)[0]]
    assert found("call (555) 123-4567 today") == [("phone", "(555) 123-4567")]
    assert found("write to bob (at) site (dot) org please") == [("email", "bob (at) site (dot) org")]
    for clean in ("Version 2.0 of 1999", "at 14:30 on 2024-01-02", "plain words only", "", "password=4f9a0b1c2d3e4f5a"):
        assert found(clean) == []


def test_viterbi_of_islands_is_viterbi_of_the_whole(field):
    rng = random.Random(4)
    bits = ["word", "(555)", "123-4567", "bob", "(at)", "site.org", "10.0.0.1", "2024", "and", "then", "4111", "1111"]
    for _ in range(60):
        words = [rng.choice(bits) if rng.random() < 0.4 else "plain" for _ in range(rng.randint(1, 40))]
        text = " ".join(words)
        path = pii.viterbi([field.scores(pii.features_of(words, False, False))], field.steps)[0]
        apart = np.zeros(len(words), int)
        at = np.cumsum([0] + [len(w) + 1 for w in words])
        for island, before, after in pii._islands(text):
            first = int(np.searchsorted(at, island[0].start()))
            apart[first : first + len(island)] = pii.viterbi([field.scores(pii.features_of([m[0] for m in island], before, after))], field.steps)[0]
        assert path.tolist() == apart.tolist()


def test_personal_data_edges(docs, field):
    rows = [*EDGES, (9, "é bob@mail.example.com and (555) 123-4567")]
    got = {r.doc_id: r for r in pii.personal_data(docs(rows), field).collect()}
    assert [(s.start, s.end, s.kind, s.base) for s in got[9].spans] == [(2, 22, "email", True), (27, 41, "phone", False)]
    assert all(not got[k].spans for k in (1, 2, 3, 5, 6, 8, None))
    assert pii.personal_data(docs([]), field).collect() == []
    assert pii.train([]).scores([["plain"]]).shape == (1, 5)


def test_language_of_held_out_texts(docs):
    rng = random.Random(1)
    words = {"aa": "lorem ipsum dolor sit amet tempor".split(), "bb": "zwölf boxkämpfer jagen viktor quer".split(), "cc": "abcde fghij klmno pqrst uvwxyz".split()}
    text = lambda lang: " ".join(rng.choices(words[lang], k=12))
    train = docs([(i, text(k), k) for i, k in enumerate("aa bb cc".split() * 20)])
    model = language_id.fit(train)
    test = [(i, text(k), k) for i, k in enumerate("aa bb cc".split() * 5)] + [(100, None), (101, "12 ! 3"), (102, ""), (103, "lorem " * 60_000), (None, "ipsum dolor")]
    got = {r.doc_id: r for r in language_id.identify(docs(test), model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in test[:15]) and got[103].lang_pred == "aa"
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs([]), model).collect() == []
    nothing = language_id.fit(docs([(1, "text", None), (2, None, "aa")]))
    assert language_id.identify(docs([(1, "text")]), nothing).first().lang_pred == "und"


def test_a_label_with_little_text_leaves_the_others_their_samples(docs):
    rng = random.Random(31)
    # Two languages of the same letters, and a label with one short text.
    words = {k: ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(300)] for k in ("aa", "bb")}
    text = lambda lang: " ".join(rng.choices(words[lang], k=15))
    train = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 100)]
    test = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 50)]
    for rare in ("ab cd efghi", "a", "ab"):
        model = language_id.fit(docs([*train, (900, rare, "cc")]))
        got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(test), model).collect()}
        assert sum(got[i] == k for i, _, k in test) >= 98, rare


def test_copies_leave_a_language_its_sample(docs):
    # 60 distinct texts, each with 200 copies: all of them serve.
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, f"{words[i % 60]} common", "aa") for i in range(12_000)]
    model = language_id.fit(docs(rows).coalesce(4))
    sample = language_id.CrossParser({"aa": [f"{w} common" for w in words[:60]]})
    assert model.languages == ["aa"] and len(model.table) > 0 and model.bits.tolist() == sample.bits.tolist()


def test_cross_parsing_counts_longest_phrases():
    model = language_id.CrossParser({"x": ["abcabd"], "y": ["zzzzzz"]})
    text = "abdabcx abq"
    symbols = language_id.symbols_of(np.array([ord(c) for c in text], np.uint32))
    sample, at, n = "abcabd", 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    assert model.phrases(model.classes(symbols), np.array([0, len(text)]))[0, 0] == n


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-notice">Accept</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
  text.<p>Second<br>line</p><script>x="</p>"</script><ul><li>a<li>b</ul><div class="comments"><p>Nice post</p></div><aside>More</aside></article>
<form><p>Sign up</p></form><footer>&copy; x</footer></body></html>"""


def test_pages():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst bold text.\nSecond\nline\na\nb"
    long = "word " * 40
    assert html_extract.main_text(f"<div>menu</div><p></p><div id=sidebar>{long}</div><p>{long}</p><p>short</p><p>{long}</p>").split("\n")[-3:] == [long.strip(), "short", long.strip()]
    assert [html_extract.main_text(x) for x in (None, "", "<", "<p", "<!-- open", "<script>x", "plain", "<p>a<td>b")] == ["", "", "<", "", "", "", "plain", "a\nb"]
    assert html_extract.main_text("<article><p title='it's'>Hello world here.</p><p>It's fine</p></article>") == "Hello world here.\nIt's fine"
    assert html_extract.main_text('<article><p title="open>One</p><p>Two</p></article>') == "One\nTwo"
    assert html_extract.main_text("<article><p a=\"x>y\" b='\"' c = 'p>q'>In</p><p data-x=it's>Out \"quoted\"</p></article>") == 'In\nOut "quoted"'
    assert html_extract.main_text("<article><p>a <b>b</b> c</i></b> d<p>e</article>") == "a b c d\ne"
    assert html_extract.body_of([0, 0, 50, 60, 3, 70, 0, 0, 0, 10], 3, 86) == (2, 6)


def test_surge_and_dive_of_pages():
    long, menu = "word " * 40, "<nav><ul><li>Home<li>News<li>About</ul></nav>"
    text = long.strip()
    # Behind a menu's lines of length 0 the sums have dived: stray lines there go, a further stretch that surges stays.
    assert html_extract.main_text(f"<h1>Headline</h1><p>By me</p><p>Today</p><p>Here</p><p>{long}</p>{menu}<p>Copyright 2020</p>") == f"Headline\nBy me\nToday\nHere\n{text}"
    assert html_extract.main_text(f"<p>Stray</p>{menu}<p>{long}</p>{menu}<p>Short</p><p>{long}</p><div class=ad>Buy</div><p>End</p>") == f"{text}\nShort\n{text}\nEnd"
    assert html_extract.main_text(f"<p>Stray</p>{menu}<p>Short</p>") == "Stray\nShort"
    # Of marked articles those without a surge go, unless none has one. What is excluded inside an article never ends it.
    teaser = "<article><h2>Other</h2></article>"
    assert html_extract.main_text(f"{teaser}<p>{long}</p><p>a</p><p>b</p><article><h1>Head</h1><p>{long}</p>{menu}{menu}<p>End</p></article>{menu}{teaser}") == f"Head\n{text}\nEnd"
    assert html_extract.main_text(f"{teaser}{menu}<article><p>Brief</p></article>") == "Other\nBrief"
    assert html_extract.main_text("<article><p>In <span class=share><div>Like</div></span></p></article>") == "In"
    assert html_extract.bodies_of([9, 0, 0, 90, 0, 0, 0, 9, 0, 0, 0, 50, 50], 3, 86) == [(0, 4), (11, 13)]


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "<p>x</p>" * 20_000, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[None].n_chars == 39_999 and got[1].url == "u"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_time_of_deep_pages_is_linear():
    import time

    def seconds(n):
        page = "<article>" + "<div><b>" * n + "text" + "</i></section>" * n + "<p>x" * n + "</b></div>" * n + "</article>"
        start = time.process_time()
        assert html_extract.main_text(page).startswith("text")
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.01)


def test_kept_words_are_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHED_WORDS", 60)
    monkeypatch.setattr(token_files, "CACHED_IDS", 400)
    monkeypatch.setattr(token_files, "NEW_WORDS", 7)
    rng, library, encoder = random.Random(5), Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE)
    word = lambda: "".join(rng.choice("abcdeé漢1.,") for _ in range(rng.randint(1, 9)))
    for k in range(60):
        texts = [" ".join(["often", "again", *(word() for _ in range(12))]), "", word() * (200 if k % 9 == 0 else 1)]
        ids, upto = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        # At most what a slice adds lies above the bounds, and nothing stays that no kept word has.
        assert len(encoder.hashes) <= 60 and len(encoder.ids) == encoder.size.sum() <= 400 + len(ids)
        assert (np.diff(encoder.hashes.astype(object)) > 0).all() and len(encoder.again) == len(encoder.hashes)


def test_words_that_came_again_stay(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 8)
    encoder = token_files.WordEncoder(WORD_BPE)
    asked = []
    library = encoder.words
    monkeypatch.setattr(encoder, "words", lambda words: asked.extend(words) or library(words))
    for k in range(30):
        encoder.encode(pa.array([f"often w{k} x{k}"]))
    assert asked.count("often") == 1


def test_arrow_batches_are_bounded_in_bytes(spark):
    from tidemark.llm.textwords import bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        bounded_batches(spark)
        assert int(spark.conf.get(name)) == 4 << 20
        rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
        long = spark.range(12, numPartitions=1).selectExpr("repeat('x', 3000000) AS t").mapInArrow(rows, "n long").collect()
        assert sum(r.n for r in long) == 12 and max(r.n for r in long) <= 2
        spark.conf.set(name, "1000000")  # a size of the session's own
        bounded_batches(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def test_token_files_round_trip(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = [*EDGES, *[(20 + k, f"Some words {k}, and MORE*** of them! don't") for k in range(30)]]
    stored = token_files.write_token_files(docs(rows), str(tmp_path / "t"), WORD_BPE, block_tokens=64, shards=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.stored_documents(stored).collect()))
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i is not None, i or 0, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    ids = library.encode(rows[12][1], add_special_tokens=False).ids
    asked = spark.createDataFrame([(rows[12][0], k) for k in (0, 3, len(ids), 999, -1)], "doc_id long, at long")
    found = {r["at"]: r.token for r in token_files.tokens_at(stored, asked).collect()}
    assert found == {0: ids[0], 3: ids[3], len(ids): 1, 999: None, -1: None}
    assert token_files.token_blocks(docs([]), WORD_BPE).collect() == []


def test_directly_addressable_codes():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([7]), rng.integers(0, 1 << 32, 3000), rng.integers(0, 70_000, 5000), np.full(600, 300)):
        levels = token_files.dac_encode(ids)
        assert (token_files.dac_decode(levels) == ids).all()
        assert all(token_files.dac_access(levels, k) == ids[k] for k in range(0, len(ids), 97))


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(EDGES), PIECE_BPE).collect()}
    for i, text in EDGES:
        n = len(sp.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["the", " ", "  ", "é", "▁", "\n", "a", "日本", "ing", "\x00"]) for _ in range(rng.randint(0, 200)))
        assert token_counts.chunked_count(PIECE_BPE, text, 40, 4) == len(sp.encode(text)), repr(text)
    assert token_counts.token_counts(docs([]), PIECE_BPE).collect() == []


def test_benchmark_passages(docs, spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, f"{text(rng.randint(15, 50)).capitalize()}. {text(4).capitalize()}.") for k in range(20)] + [(98, None), (99, ""), (None, f"{text(30)}.")]
    rows, want = [], {}
    for i in range(150):
        parts, own = [text(rng.randint(0, 150))], []
        if i % 5 == 0:
            k, item = items[rng.randrange(20)]
            if i % 10 == 0:  # a paraphrase of the question, with its answer
                head, tail = item.split(". ", 1)
                item = " ".join(w for n, w in enumerate(head.upper().split()) if n % 6) + ", " + tail
            parts, own = [*parts, item, text(rng.randint(0, 150))], [k]
        rows.append((i, " ".join(parts)))
        want[i] = own
    rows += [(200, None), (201, ""), (202, items[-1][1]), (203, text(50_000) + " " + items[3][1])]
    want |= {200: [], 201: [], 202: [None], 203: [3]}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.contaminated(docs(rows), bench).collect()} == want
    assert decontamination.contaminated(docs([]), bench).collect() == []
    assert not decontamination.contaminated(docs([(1, "a b")]), bench.limit(0)).first().contaminated


def test_benchmark_of_more_items_than_directions(docs, spark):
    rng = random.Random(18)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.randint(20, 50))) for k in range(1100)]
    rows = [(k, f"{text(40)} {t} {text(40)}") for k, t in items] + [(5000 + k, text(120)) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontamination.contaminated(docs(rows), bench).collect()}
    assert got == {i: [i] if i < 5000 else [] for i, _ in rows}


def test_benchmark_items_of_common_words(docs, spark):
    rng = random.Random(28)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(30)) for k in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # A third of the rows are copies of one text with an item; another item is quoted by a tenth of the rows; two rows with one each.
    hot = f"{text(30)} {items[0][1]} {text(30)}"
    rows = [(k, hot, [0]) for k in range(100)] + [(100 + k, f"{text(40)} {items[1][1]} {text(40)}", [1]) for k in range(30)]
    rows += [(200 + k, f"{text(50)} {items[k][1]} {text(50)}", [k]) for k in range(2, 8)] + [(300 + k, text(120), []) for k in range(164)]
    got = {r.doc_id: r["items"] for r in decontamination.contaminated(docs([r[:2] for r in rows]), bench).collect()}
    assert got == {i: x for i, _, x in rows}
    small = docs([(1, items[0][1]), (2, items[0][1]), (3, text(50))])
    for some in (bench, bench.where("item_id = 0")):
        assert {r.doc_id: r["items"] for r in decontamination.contaminated(small, some).collect()} == {1: [0], 2: [0], 3: []}


@pytest.mark.parametrize("n, rank", [(4, 256), (120, 256), (120, 6)])
def test_latent_space_holds_the_leading_directions_of_the_passages(docs, n, rank):
    """Also in a table so small that each word is in many of its texts, and when the items fill the rank."""
    rng = random.Random(48)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(150)]
    text = lambda n: " ".join(words[min(rng.randrange(150), rng.randrange(150))] for _ in range(n))
    items = [(k, text(30)) for k in range(6)]
    rows = [(k, text(rng.randint(0, 200))) for k in range(n)]
    (space,) = decontamination.fit(docs(rows).select("text").withColumnRenamed("text", "_text"), items, rank)
    word = {h: k for k, h in enumerate(space.cell.tolist())}
    hashes = lambda t: decontamination._folded(decontamination.pa.array([t])).hash.tolist()
    holding = np.zeros(len(word))
    for _, t in rows:
        holding[list({word[h] for h in hashes(t) if h in word})] += 1
    idf = np.log1p(n / np.maximum(holding, 1))
    passages = []
    for _, t in rows:
        h = hashes(t)
        for a in range(0, len(h), 32):
            passages.append(np.zeros(len(word)))
            for x in h[a : a + 64]:
                if x in word:
                    passages[-1][word[x]] += idf[word[x]]
    basis = space.basis / idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    own, more = basis[:, : len(items)], basis[:, len(items) :]
    left = np.array(passages) - np.array(passages) @ own @ own.T
    _, best, right = np.linalg.svd(left)
    assert np.linalg.norm(more.T @ right[0]) > 0.99
    assert ((left @ more) ** 2).sum() >= 0.9 * (best[: decontamination.DIRECTIONS] ** 2).sum() and more.shape[1] <= decontamination.DIRECTIONS
    assert np.allclose(np.linalg.norm(space.item, axis=1), 1, atol=1e-4)  # no item's direction is cut


def test_paraphrases_against_all_pairs_and_what_the_directions_of_the_passages_do(docs, spark):
    rng = random.Random(58)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    text = lambda n: " ".join(words[min(rng.randrange(400) for _ in range(3))] for _ in range(n))
    items = [(k, f"{text(rng.randint(15, 59))}. {text(4)}.") for k in range(30)]
    rows = []
    for i in range(120):
        head, tail = items[rng.randrange(30)][1].split(". ", 1)
        rows.append((i, " ".join([text(rng.randint(0, 120)), *(w for w in head.split() if rng.random() < 0.85), tail, text(rng.randint(0, 120))])))
    given = docs(rows).select("doc_id", decontamination.F.col("text").alias("_text"))
    spaces = decontamination.fit(given, items)
    want = {}
    for i, t in rows:
        h = decontamination._folded(decontamination.pa.array([t])).hash
        around = lambda a, k: h[max(0, a - len(spaces[0].words[k])) : a + 64 + len(spaces[0].words[k])]
        want[i] = [k for k in range(30) if any(decontamination._decide(spaces[0], k, around(a, k)) for a in range(0, len(h), 32))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.contaminated(docs(rows), bench).collect()} == want and sum(map(len, want.values())) > 60

    def candidates(space):
        found = 0
        for _, t in rows:
            w = decontamination._folded(decontamination.pa.array([t]))
            block, row, _ = decontamination._blocks(w)
            b, v = decontamination._entries(w, block, space.cell)
            latent = decontamination._rows_times(b, v, len(row), space.basis, space.often)
            latent[:-1] += latent[1:]
            found += decontamination._near(space, latent)[0].size
        return found

    some = spaces[0]
    assert candidates(some) < 0.9 * candidates(some._replace(basis=some.basis[:, :30], item=some.item[:, :30]))


def test_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_length(a, b) == t[-1, -1]


def filled(sizes, weights, total, most=2.0):
    """Targets by handing the excess out again until none is above its cap."""
    target, capped = {}, set()
    while True:
        free = [k for k in sizes if k not in capped]
        left = total - sum(most * sizes[k] for k in capped)
        for k in sizes:
            target[k] = most * sizes[k] if k in capped else left * weights[k] / sum(weights[x] for x in free)
        over = {k for k in free if target[k] > most * sizes[k]}
        if not over:
            return target
        capped |= over


def test_mix(docs):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(800)] + [(900, None, None, "a"), (901, None, None, "empty"), (5, "twice", None, "b"), (None, "n n", None, "b")]
    got = mixing.mix(docs(rows), block_rows=16, levels=3).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "shards").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, dict(zip(order, [5, 2, 1] * 3)), 1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 16
    assert all(r.taken == r.size * len(r.shards) <= 2 * r.size for r in got)
    assert {s for r in got for s in r.shards} == set(range(8))
    again = mixing.mix(docs(rows[::-1]), block_rows=16, levels=3).select("row.doc_id", "size", "taken", "shards").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in (type(again[0])(doc_id=r.doc_id, size=r["size"], taken=r.taken, shards=r.shards) for r in got))
    assert mixing.mixed_rows(mixing.mix(docs(rows)), shards=2).count() == sum(len(r.shards) for r in mixing.mix(docs(rows)).select("shards").collect())
    assert mixing.mix(docs([])).collect() == []


def test_splitting_tree_deals_all_blocks(spark):
    quotas = spark.createDataFrame([(0, 500), (1, 20), (2, 0), (3, 7)], "source_no long, quota long")
    leaves = mixing.splitting_tree(quotas, 3, 1).collect()
    total = {k: sum(r.quota for r in leaves if r.source_no == k) for k in range(4)}
    assert total == {0: 500, 1: 20, 2: 0, 3: 7} and all(r.quota >= 0 for r in leaves)
    per_leaf = [sum(r.quota for r in leaves if r.leaf == k) for k in range(8)]
    assert max(per_leaf) - min(per_leaf) <= 2
