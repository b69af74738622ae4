"""Every operator against brute force or an exact round trip, and on odd tables."""

import base64
import hashlib
import random
import re
import time
import zlib

import brute
import numpy as np
import pytest
from samples import prose
from pyspark.sql import functions as F

from rasterlake.llm import chat, decontaminate, html, language, lines, near, packing, pii, quality, substrings


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key], str(r)))


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- 1 packing ---------------------------------------------------------------


def check_packing(packed, texts, capacity=1024):
    plain = packing.encoder("byte_bpe_50k")._plain
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_round_trip(spark, odd_texts):
    texts = [*odd_texts, " " * 300_000, "a <|endoftext|> b", *(prose(k, 30 + 17 * k) for k in range(60))]
    packed = packing.pack_documents(table(spark, texts), group_pieces=32).collect()
    used = check_packing(packed, texts)
    assert used <= -(-sum(r.length for r in packed) // 1024) + 4


@pytest.mark.parametrize("low,high", [(1, 1024), (250, 600), (513, 1024), (1, 40)])
def test_local_search_keeps_items_and_never_loses(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 600)
    start, packed = packing.best_fit_decreasing(lengths, 1024), packing.pack(lengths)
    assert sorted(i for b in packed for i in b) == list(range(600))
    assert max(lengths[b].sum() for b in packed) <= 1024
    assert packing.fewest_bins(lengths, 1024) <= len(packed) <= len(start)


def test_local_search_empties_bins():
    lengths = np.random.default_rng(4).integers(330, 360, 900)
    assert len(packing.pack(lengths)) < len(packing.best_fit_decreasing(lengths, 1024))


def test_fast_ids_are_those_of_tokenizers():
    rng, encode = random.Random(1), packing.encoder("byte_bpe_50k")
    for _ in range(3000):
        text = "".join(rng.choice("ab 's 'll\n\t\r  é中文😀́٣Ⅷ1²!?-_<|>\x00\x85İß") for _ in range(rng.randint(0, 40)))
        assert encode.ids(text).tolist() == encode._plain.encode(text, add_special_tokens=False).ids


# --- 2 pii -------------------------------------------------------------------

PRIVATE = "card 4111 1111 1111 1111, ip 10.1.2.3, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, born 1987-06-05 or 24.12.1999, call +1 (212) 555-0123, mail jo.doe7@mail.example.com, password=abcd1234efgh"


def test_pii_is_valid_linked_and_native(spark):
    texts = [PRIVATE, f"again 10.1.2.3 {PRIVATE}", "bad 4111 1111 1111 1112, 256.1.2.3, 000-12-3456, 2001-02-30, DE88 3704 0044 0532 0130 00", None, ""]
    done = pii.pseudonymise(table(spark, texts))
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())
    got = rows(done)
    found = lambda t: re.findall(pii.PATTERN, t)
    first, second = found(got[0].text), found(got[1].text)
    assert second == [first[1], *first] and got[0].n_values == 9
    for old, new in zip(found(PRIVATE), first, strict=True):
        assert old != new and re.sub("[A-Za-z0-9]", "#", old) == re.sub("[A-Za-z0-9]", "#", new) or "." in old
    digits = [int(c) for c in re.sub(r"\D", "", first[0])]
    assert sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) in range(0, 200, 10)
    assert [r.text for r in got[2:]] == texts[2:] and [r.n_values for r in got[2:]] == [0, 0, 0]


def test_feistel_is_a_permutation(spark):
    made = spark.range(10_000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k").alias("x"))
    assert made.distinct().count() == 10_000 and made.filter(~F.col("x").rlike("^[0-9]{4}$")).count() == 0
    pair = lambda s: F.concat_ws(",", s["l"], s["r"])
    assert spark.range(37 * 91).select(pii.feistel_pair(F.floor(F.col("id") / 91), F.col("id") % 91, 37, 91, "k", pair).alias("x")).distinct().count() == 37 * 91


# --- 3 decontamination -------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    items = [(0, prose(100, 40)), (1, prose(101, 13)), (2, "two words"), (3, "Two  WORDS!"), (4, None), (5, "..."), (6, prose(102, 5)), (7, prose(100, 40)), (8, "é")]
    shared = " ".join(prose(100, 40).split()[3:21])
    texts = [prose(k, 60) + " " + (shared.upper() if k % 3 else items[k % 9][1] or "") + " " + prose(k + 500, 20 * k) for k in range(40)]
    texts += [None, "", "two words", "é", *[shared] * 3, " ".join(["two words"] * 500), prose(9, 50_000) + shared]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_windows": 7}):
        got = rows(decontaminate.decontaminate(table(spark, texts), bench, **options))
        assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == [brute.contamination(t, items) for t in texts]
    none = decontaminate.decontaminate(table(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)


# --- 4 language --------------------------------------------------------------

TONGUES = {"aa": "tra lami sono perdi velo", "bb": "krug wosch zent murg pflo", "cc": "thing hethe rought whill nder"}


def tongue(lang, seed, n):
    rng, parts = random.Random(seed), TONGUES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_mixtures(spark):
    langs = list(TONGUES)
    data = [(i, tongue(langs[i % 3], i, 40), langs[i % 3]) for i in range(150)]
    mixed = [(1000, tongue("aa", 1, 60) + " " + tongue("bb", 2, 30), None), (1001, None, "aa"), (1002, "12 ,;", "bb"), (1003, "", None)]
    docs = spark.createDataFrame([*data, *mixed], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].lang_pred == lang for i, _, lang in data if got[i].held_out)
    shares = {x.lang: x.share for x in got[1000].languages}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 2 / 3) < 0.1 and got[1000].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    flipped = language.identify(docs.withColumn("lang", F.when(~language.held_out(), F.col("lang")))).collect()
    assert {r.doc_id: r.lang_pred for r in flipped} == {i: r.lang_pred for i, r in got.items()}


def test_language_learns_every_label(spark):
    rng = random.Random(8)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for k in range(300)}
    data = [(3 * k + c, " ".join(own), lang) for k, (lang, own) in enumerate(words.items()) for c in range(3)]
    learned = {lang for i, _, lang in data if zlib.crc32(str(i).encode()) % 5}
    got = language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert len(learned) > 256 and all(r.lang_pred == data[r.doc_id][2] for r in got if data[r.doc_id][2] in learned)


# --- 5 html ------------------------------------------------------------------


def page(k, article=True):
    body = f"<h1>Title {k} &amp; more</h1><p>First <b>bold{k}</b> part.<p>Second&nbsp;&eacute; part\n {k}<ul><li>one<li>two {k}</ul><section class='comments'><p>reader {k}</p></section>"
    main = f"<article>{body}</article>" if article else f"<div class=content>{body}</div><div class=motd><p>Fixed words of every page</p></div>"
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><header>Head {k}</header><nav><ul><li><a href=/>home</a></ul></nav><!-- c --><div class='ad'>buy {k}</div><div id=cookie-notice>cookies</div>{main}<form><input><button>go</button></form><aside>side {k}</aside><footer>foot {k}</footer></body></html>"


def test_html_extraction(spark):
    expected = lambda k: f"Title {k} & more First bold{k} part. Second é part {k} one two {k}"
    data = [(k, f"http://h{k % 2}.example/{k}", page(k)) for k in range(20)] + [(100 + k, "http://plain.example/", page(k, False)) for k in range(20)]
    data += [(200, None, None), (201, "odd", ""), (202, "http://h0.example", "just text"), (203, "http://h0.example", "<p>a<br>b<p>" + "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for limit in (10**6, 0):
        got = {r.page_id: r.text for r in html.extract(pages, broadcast_branches=limit).collect()}
        assert all(got[k] == expected(k) and got[100 + k] == expected(k) for k in range(20))
        assert [got[200], got[201], got[202], got[203]] == ["", "", "just text", "a b deep"]
    assert html.extract(pages.limit(0)).collect() == []


def test_html_measures_what_articles_hold(spark):
    body = lambda k: f"<h1>Title {k}</h1><p>Own words {k}</p><div class=zz><p>Read us every week</p></div><p>End {k}"
    data = [(k, "http://a.example/", f"<body><article>{body(k)}</article></body>") for k in range(20)] + [(100 + k, "http://b.example/", f"<body><main>{body(k)}</main></body>") for k in range(4)]
    data += [(200 + k, "http://c.example/", f"<body><div>Link {k}</div><article><p>Equal on all pages</p></article></body>") for k in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k} Own words {k} End {k}" for k in range(20))
    assert all(got[100 + k] == f"Title {k} Own words {k} Read us every week End {k}" for k in range(4))
    assert all(got[200 + k] == "Equal on all pages" for k in range(20))


def test_html_importance_equals_brute_force(spark):
    """Entropies of a small site, counted plainly from its branches' texts and child elements."""
    def build(k):
        return f"<body><div class=top><p>Same on all</p></div><div class=mid><p>Own {k}</p></div><div class=half><p>Word {k % 2}</p></div><div class=list>{'<p>x</p><span>y</span><section>z</section>' * (k % 3)}</div></body>"

    pages = [(f"http://s.example/{k}", build(k)) for k in range(12)]
    seen = {}
    for url, page_ in pages:
        tree = html.parse("s.example", page_)
        for branch, content, looks, kind in html.features(tree):
            for aspect, value in ((0, content), (1, looks)):
                seen.setdefault((branch, kind), ({}, {}))[aspect].setdefault(value, []).append(url)

    def entropy(groups, n):
        return -sum(len(g) / n * np.log2(len(g) / n) for g in groups.values()) / np.log2(n)

    want = {}
    for (branch, _), aspects in seen.items():
        n = sum(map(len, aspects[0].values()))
        want[branch] = html.CONTENT_WEIGHT * entropy(aspects[0], n) + (1 - html.CONTENT_WEIGHT) * entropy(aspects[1], n)
    docs = spark.createDataFrame([("s.example", p) for _, p in pages], "host string, html string")
    got = {r.branch % 2**64: r.importance for r in html.importance(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)
    assert sum(v < html.LOW_IMPORTANCE for v in got.values()) == 4  # the division that never changes, the one with two texts, and their paragraphs


def test_html_tree_changes_pages(spark):
    """Pages whose text the style tree alone decides: nothing in them is named."""
    build = lambda k: f"<body><div class=a1><p>Welcome to our site</p></div><div class=b2><h1>Story {k}</h1><p>Own words {k}</p><div class=c3>Read more every week</div></div></body>"
    pages = [(k, "http://u.example/", build(k)) for k in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    without = {r.page_id: r.text for r in html.extract(frame, low_importance=0.0).collect()}
    assert sum(got[k] != without[k] for k in got) == 30
    assert all(got[k] == f"Story {k} Own words {k}" for k in got)


def test_html_deep_pages_take_linear_time():
    def seconds(n):
        page_ = "".join(f"<div><p>t{k}" for k in range(n)) + "</b></x></p>" * n
        began = time.perf_counter()
        tree = html.parse("h", page_)
        assert len({b for b, *_ in html.features(tree)}) == 2 * n
        assert html.main_text(tree, lambda b: np.zeros(len(b), bool)).count(" ") == n - 1
        return time.perf_counter() - began

    seconds(500)
    assert seconds(10_000) < 12 * max(seconds(2_000), 0.02)


def test_html_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://h/", page(1), "x"), (1, "http://h/", page(1), "x"), (None, None, None, "y"), (2, "http://h/", "<p>" + "word " * 200_000, "z")], "page_id long, url string, html string, text string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    found = rows(got, "page_id")
    assert len(found) == 4 and found[0].text == "" and found[1] == found[2] and found[3].text == ("word " * 200_000).strip()
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("open_, kept", [("section id=related-work", True), ("h2 id=search", True), ("div class=entry-header", True), ("section id=social-history", True), ("div id=banner-design", True), ("section id=comments", True), ("div class='box ad'", False), ("div id=comments", False), ("section class=related", False), ("div class=ad-2", False)])
def test_html_names_inside_articles(open_, kept):
    tree = html.parse("h", f"<body><article><p>before</p><{open_}>inner</{open_.split()[0]}><p>after</p></article></body>")
    assert html.main_text(tree, lambda branches: np.zeros(len(branches), bool)) == ("before inner after" if kept else "before after")


# --- 6 substrings ------------------------------------------------------------


def test_substring_dedup_survives_shifts(spark):
    passage = prose(300, 60)
    texts = [prose(k, 40 + k) + (" " + passage + " " if k % 4 == 0 else " ") + prose(k + 50, 30) for k in range(40)]
    texts += [None, "", "short", "é中" * 5000, *["Released under some license."] * 9]
    got = rows(substrings.dedup_substrings(table(spark, texts)))
    for k, r in enumerate(got):
        has = k < 40 and k % 4 == 0
        first = r.first_docs or []
        assert (r.n_shared > 0) == has and (r.n_dropped > 0) == (has and k > 0) == bool(first) and all(f % 4 == 0 and f < k for f in first)
        raw = (texts[k] or "").encode()
        spans = [(s.start, s.stop) for s in r.dropped or []]
        assert all(raw[a:b].decode().strip()[:20] in " ".join((texts[0], passage)) for a, b in spans)
        assert len(r.text.encode()) == len(raw) - sum(b - a for a, b in spans)
        assert sum(b - a for a, b in spans) > 100 or not spans


def test_substring_dedup_finds_short_passages(spark):
    short = lambda k: " ".join(w[:5] for w in prose(k, 51).split())
    passages = [short(k) for k in range(1000, 1120)]
    texts = [f"{prose(2000 + 2 * k + side, 25 + (k + 7 * side) % 31)} {p} {prose(4000 + 2 * k + side, 30)}" for side in (0, 1) for k, p in enumerate(passages)]
    texts += [prose(7000, 30) + " spam" * 80 + " " + prose(7001, 30), prose(7002, 37) + " spam" * 80 + " " + prose(7003, 30)]
    got = rows(substrings.dedup_substrings(table(spark, texts)))
    assert sum(r.n_shared > 0 for r in got[:120]) >= 118 and sum(r.n_dropped > 0 for r in got[120:240]) >= 118
    assert got[241].first_docs == [240]
    for r, p in zip(got[120:240], passages, strict=True):
        raw = texts[r.doc_id].encode()
        assert all(raw[s.start + 8 : s.stop - 8].decode() in p for s in r.dropped or [])


# --- 7 chat ------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "a\nb\\n<|image|>", None, ""]
    turns = [(c, t, ["user", "assistant", "sys\ntem", None][t % 4], hard[(c + t) % 7]) for c in range(7) for t in range(6)] + [(None, 0, "assistant", "x"), (3, 0, "user", "again")]
    random.Random(1).shuffle(turns)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t, r or "", x or "") for c, t, r, x in turns if c == conv)
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    content = '[{"type":"text","text":"see <|image|>"},{"type":"image","ref":"a.png","width":57,"height":28},{"type":"audio","ref":"b","seconds":2},{"type":"document","pages":3},{"type":"odd"}]'
    got = chat.format_turns(spark.createDataFrame([(1, 0, "user", content)], "conv_id long, turn long, role string, text string"), typed=True).first()
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "a.png", 3), ("audio", "b", 25), ("document", "", 768), ("attachment", "", 1)]
    assert all(got.formatted[a["at"] :].startswith(f"<|{a.kind}|>") for a in got.attachments)
    assert chat.read_turn(got.formatted)[1].startswith("see <|image|><|image|>")


def test_chat_odd_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (1, None, None, None, 6), (2, 1, "assistant", "word " * 100_000, 7)], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 3, 2: 1} and got[2].loss_chars == 500_000
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).collect() == []


# --- 8 near duplicates -------------------------------------------------------


@pytest.mark.parametrize("crowd,compared,local", [(32, 20_000, 10_000), (1, 0, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, crowd, compared, local):
    for name, value in (("CROWD", crowd), ("COMPARED", compared), ("COMPARED_PER_ROW", 0 if compared == 0 else 4), ("FIRSTS", 1 if crowd == 1 else 4), ("LOCAL_LINKS", local), ("HOT_ROWS", 20 if crowd == 1 else 1000)):
        monkeypatch.setattr(near, name, value)
    rng = random.Random(crowd)
    docs, base = [], prose(1, 120).split()
    for _ in range(90):  # copies of copies, of one to many edits
        own = list(rng.choice(docs).split() if docs and rng.random() < 0.5 else base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 9])):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        docs.append(" ".join(own))
    docs += [prose(k, n) for k, n in ((5, 3), (5, 3), (6, 4), (7, 1), (8, 300))] + ["x", "X", "x y", "x Y", " ", "", None, None]
    docs += [" ".join(base[:k]) for k in (110, 105, 101, 95, 60)] + [prose(20 + k, 10) + " " + " ".join(base[:60]) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, docs)).collect()}
    assert got == brute.components(list(enumerate(docs)))


def test_second_pass_is_linear_in_a_group(spark, monkeypatch):
    """Pairs that are counted among near copies with one to three edits, most of them not linked to each other."""
    counted, links = [], near._links
    monkeypatch.setattr(near, "_links", lambda pairs, *rest: counted.append(pairs.count()) or links(pairs, *rest))
    monkeypatch.setattr(near, "COMPARED", 0)
    monkeypatch.setattr(near, "CROWD", 8)
    made = {}
    for m in (150, 300):
        rng, base, docs = random.Random(5), prose(1, 120).split(), []
        for _ in range(m):
            own = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                k, kind = rng.randrange(len(own)), rng.random()
                own[k : k + (kind < 0.7)] = [] if kind < 0.2 else [f"edit{rng.randrange(10**6)}"]
            docs.append(" ".join(own))
        counted.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, docs)).collect()}
        assert got == brute.components(list(enumerate(docs)))
        made[m] = sum(counted)
    assert made[300] <= 2.5 * made[150]


def test_lists_of_differences_stay_linear(spark, monkeypatch):
    """Differences that the rounds on one crowded list take up in all, among rows of 1 to 30 edits of four columns each."""
    taken, told_apart = [], near._told_apart
    monkeypatch.setattr(near, "_told_apart", lambda differing, *rest: taken.append(differing.selectExpr("sum(size(differ))").first()[0] or 0) or told_apart(differing, *rest))
    monkeypatch.setattr(near, "COMPARED", 0)
    monkeypatch.setattr(near, "FIRSTS", 1)
    rng, rows = random.Random(3), []
    for node in range(160):
        gone = {t for at in rng.sample(range(397), rng.randint(1, 30)) for t in range(at, min(at + 4, 397))}
        rows.append((0, node, 397, 0, [*gone, *(1000 * (node + 1) + t for t in gone)]))
    differing = spark.createDataFrame(rows, "list long, node long, n long, alone int, differ array<long>")
    monkeypatch.setattr(near, "_differences", lambda *_: differing)
    found = near._crowded_links(None, spark.createDataFrame([], "node long, component long"), None, None, 4, 85)
    got = {r.node: r.component for r in found.collect()}
    want = list(range(160))
    sets = [set(r[4]) for r in rows]
    for x in range(160):
        for y in range(x):
            if 185 * len(sets[x] ^ sets[y]) <= 15 * 794 and want[x] != want[y]:
                low, high = sorted((want[x], want[y]))
                want = [low if c == high else c for c in want]
    assert [got.get(k, k) for k in range(160)] == want and len(set(want)) > 1
    assert sum(taken) <= 2 * taken[0], taken


def test_rows_that_meet_late_are_not_compared(spark, monkeypatch):
    """Texts that share a column only behind more columns of their own than linked ones may have are no pairs, and no list of differences."""
    counted, links = [], near._links
    monkeypatch.setattr(near, "_links", lambda pairs, *rest: counted.append(pairs.count()) or links(pairs, *rest))
    monkeypatch.setattr(near, "_differences", lambda members, *_: pytest.fail(f"{members.count()} rows in lists"))
    rng, base, docs = random.Random(7), prose(1, 200).split(), []
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(1, 32), 6):
            own[6 * at] = f"edit{rng.randrange(10**9)}"
        docs.append(" ".join(own))
    docs.append(docs[0] + " more")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, docs)).collect()}
    assert got == brute.components(list(enumerate(docs))) and got[60][1] == 0
    assert sum(counted) <= 5


def test_meeting_rows_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    for node in range(240):
        n, token = rng.choice([90, 100, 100, 115, 130, 200, 1000]), node % 3
        pos = rng.randrange(n - -(-85 * n // 100) + 1)
        rows.append((token, node, n, 185 * (n - pos) // 85 - n, rng.choice([0, 1, 2, 1000 + node, 1000 + node]), 0))
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[4] != y[4] and x[2] <= y[3] and y[2] <= x[3]}
    of = spark.createDataFrame(rows, "token long, node long, n long, reach long, component long, main long")
    left = near._may_meet(of)
    for found in (near._meeting(of).collect(), near._meeting(left).collect()):
        assert len(found) == len(want) and {(min(r.x, r.y), max(r.x, r.y)) for r in found} == want
    assert 0 < len(want) and left.count() < 240


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    a, b, c, d = (prose(k, 50) for k in range(4))
    docs = spark.createDataFrame([(1, a, 0, "x"), (2, a, 1, "x"), (2, b, 2, "x"), (3, c, 3, "x"), (3, d, 4, "x"), (None, d, 5, "x"), (None, prose(9, 50), 6, "x"), (None, None, 7, "x")], "doc_id long, text string, text_key long, component string")
    assert sorted(r.text_key for r in near.one_of_each(docs).collect()) == [0, 2, 3, 4, 6, 7]
    assert near.one_of_each(docs).columns == docs.columns and near.one_of_each(docs.limit(0)).collect() == []


def test_keep_clean_keeps_other_texts_of_an_id(spark):
    item = prose(60, 40)
    docs = spark.createDataFrame([(1, item, 0), (1, prose(61, 60), 1), (None, item, 2), (None, None, 3), (2, f"{prose(62, 30)} {item}", 4)], "doc_id long, text string, n_words long")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.n_words for r in decontaminate.keep_clean(docs, bench).collect()) == [1, 3]


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, prose(1, 50), "a"), (2, prose(1, 50), "b"), (3, None, "c"), (4, "", "d"), (1, prose(1, 50), "a")], "doc_id long, text string, extra string")
    assert [r.doc_id for r in rows(near.one_of_each(docs))] == [1, 3, 4]


# --- 9 and 10 ----------------------------------------------------------------


def test_quality_counts_equal_brute_force(spark, odd_texts):
    texts = [*odd_texts, "a b c d e f g h " * 3 + prose(2, 60), "# one\n# one\n\n \n# two|<>", prose(4, 19), prose(4, 20)]
    got = rows(quality.quality_rules(table(spark, texts)))
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute.quality(t) for t in texts]


def test_quality_verdicts_equal_brute_force(spark, odd_texts):
    rng = random.Random(4)
    texts = [*odd_texts, *(prose(k, rng.choice([20, 30, 60, 120, 400, 1500, 9000])) for k in range(30))]
    texts += [f"{prose(k, 400)} {('same again ' * 700) if k % 2 else base64.b85encode(rng.randbytes(4000)).decode()}" for k in range(12)]
    got = rows(quality.quality_rules(table(spark, texts)))
    assert [r.kept for r in got] == [not brute.quality(t)[-1] and brute.compression_kept(t) for t in texts]
    assert 10 < sum(r.kept for r in got) < len(texts) - 10


def test_quality_bands(spark):
    noise = base64.b85encode(random.Random(1).randbytes(6000)).decode()
    spaced = " ".join(noise[i : i + 7] for i in range(0, len(noise), 7))
    repeated = " ".join(f"{w} {w[::-1]}" for w in prose(1, 4).split() * 400)
    docs = table(spark, [prose(1, 900), spaced, repeated, prose(2, 100)])
    assert [r.kept for r in rows(quality.quality_rules(docs))] == [True, False, False, True]
    assert [r.doc_id for r in rows(quality.keep_good(docs))] == [0, 3]


def test_line_dedup_equals_brute_force(spark):
    texts = [f"Common Line\nown {k}\n\n  common line \t\nhalf\n" if k % 2 else f"COMMON LINE\r\nown {k}" for k in range(30)]
    texts += [None, "", "\n", "rare\nrare\nrare", "x\n" * 5000, "common line", *["nine\nlines"] * 9]
    want = brute.lines(texts)
    for n in ("4", "23"):  # few and many partitions: the hot key is cut by their edges
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = rows(lines.drop_lines(table(spark, texts)))
        assert [(r.n_lines, r.n_dropped, brute.sha(r.text)) for r in got] == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_bitmaps(spark):
    texts = [f"a\nown {k}\nb" for k in range(12)]
    maps = rows(lines.keep_bitmaps(table(spark, texts)))
    assert [(lines.kept_lines(r.keep, r.n_lines).tolist(), r.n_dropped) for r in maps] == [([False, True, False], 2)] * 12


def test_runs_cut_by_partitions(spark):
    docs = table(spark, [f"hot\nown {k}" for k in range(200)])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    assert docs.count() == sum(r.n_dropped for r in lines.drop_lines(docs).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- odd tables --------------------------------------------------------------

ON_DOCS = {
    "pack": packing.pack_documents,
    "pii": pii.pseudonymise,
    "language": language.identify,
    "substrings": substrings.dedup_substrings,
    "near": near.near_duplicates,
    "quality": quality.quality_rules,
    "lines": lines.drop_lines,
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, prose(2, 40))], "item_id long, text string")),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_odd_and_empty_tables(spark, odd_docs, empty_docs, name):
    found = ON_DOCS[name](odd_docs)
    ids = [r[0] for r in found.select("doc_id").distinct().collect()]
    assert len(ids) == odd_docs.select("doc_id").distinct().count()
    if name != "pack":
        assert found.count() == odd_docs.count()
    assert ON_DOCS[name](empty_docs).collect() == []


def test_copies_meet_once_in_a_block(spark):
    """Rows of equal sets are one row of a column, hot or not, and its pivot is the same for all."""
    rows = spark.createDataFrame([(k % 3, 9, [1, 2, 10 + k % 3], [7]) for k in range(30)], "node long, n long, prefix array<long>, hot array<long>")
    block = near._block(rows).collect()
    assert sorted((r.token, r.node, r.n) for r in block) == [(t, k, 9) for t in (1, 2, 7) for k in range(3)]
    assert len({(r.token, r.pivot) for r in block}) == 3
