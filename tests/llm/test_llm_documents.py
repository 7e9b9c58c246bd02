"""Language, pages, mixing, packing, sharding."""

import binascii
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from conftest import clashing
from salesloom.llm import language, mixing, packing, pages, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# ------------------------------------------------------------------ language

SYLLABLES = {"aa": ["the", "an", "er", "on"], "bb": ["der", "ein", "sch", "ü"], "cc": ["que", "los", "ció", "ñ"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(documents):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, speech(rng, lang, rng.randint(5, 80)), lang, "s"))
    special = [
        (1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 ?! 3", "bb", "s"), (None, rows[0][1], None, "s"),
        (1003, speech(rng, "bb", 300_000), None, "s"), (0, rows[0][1], "aa", "s"),
    ]
    found = language.language(clashing(documents(rows + special))).collect()
    assert len(found) == len(rows) + len(special)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    by_id = defaultdict(list)
    for r in found:
        assert 0 <= r.score <= 1
        by_id[r.doc_id].append(r.lang_pred)
    assert [by_id[i][0] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert by_id[0] == ["aa", "aa"] and by_id[None] == ["aa"]
    held = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(by_id[i][0] == lang for i, lang in held) >= 0.97 * len(held)


def test_held_out_rows_teach_nothing(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert language.language(documents([(held, "the an", "aa", "s")])).first().lang_pred == "und"
    assert language.language(documents([])).count() == 0


def test_ngrams_by_brute_force(monkeypatch):
    def brute(text):
        chars = "".join(c if c.isalpha() else " " for c in text.lower())
        chars = f" {' '.join(chars.split())} " if chars.split() else ""
        grams = [chars[i:i + n] for n in (1, 2, 3) for i in range(len(chars) - n + 1)]
        return Counter(g for g in grams if g.strip() and " " not in g[1:-1])

    def decode(g):
        out = ""
        while g:
            out, g = chr(g & 0x1FFFFF) + out, g >> 21
        return out

    for chunk in (1 << 20, 4, 7):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in ("Ab ab!", "  x", "Żółw 12 żółw-żółw", "a", "𝔘𝔘 b", "The end.\n"):
            grams, counts = language.ngrams(text)
            got = {decode(int(g)): int(n) for g, n in zip(grams, counts, strict=True)}
            assert got == dict(brute(text)), (text, chunk)


def test_out_of_place_distance():
    p = language.Profiles({"x": np.array([5, 9, 7], np.uint64)})
    far = p.distances(np.array([9, 5, 1], np.uint64))
    assert far[0] == pytest.approx((1 + 1 + language.PROFILE) / 3 / language.PROFILE)


# ------------------------------------------------------------------ pages

TEXT = "The cat is on the mat and it was a good day for all of the people who came to see it in the town."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""),
    ("<p>Just &amp; this &eacute;&#33;", "Just & this é!"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{TEXT}<br>a<p>Of.</article><footer>{TEXT}</footer>", f"T\n{TEXT} a\nOf."),
    (f"<div class='ad'>buy<article><p>{TEXT}</p><div class=comments><p>{TEXT}</div></article>", TEXT),
    (f"<div id=sidebar><p>{TEXT}</p></div><div><p>{TEXT}</p><p>Short.</p></div><div class='cookie-notice'>x</div>", f"{TEXT}\nShort."),
    (f"<form><p>{TEXT}</form><header>Site</header><main><header><h1>A</h1></header><p>{TEXT}</main>", f"A\n{TEXT}"),
    (f"<article><p>{TEXT}</p><script>var a='<p>x</p>'</script><style>p{{}}</style><!-- c --><p>x  \n y</article>", f"{TEXT}\nx y"),
    ("<article><p>kurz</p></article>", "kurz"),
    (f"<html class=search><body class='single right-sidebar'><p>{TEXT}</p><div class=sidebar>x</div>", TEXT),
    (f"<body class='comments-open' id=page-menu><article><p>{TEXT}</p></article></body>", TEXT),
    (f"<section id=comments><article><p>{TEXT}</article></section><article><p>{TEXT}<p>z</article>", f"{TEXT}\nz"),
    ("<<a href='x<p>q", "<<a href='x<p>q"), (f"<p>{TEXT}<![CDATA[ x ]]></p>", TEXT),
])
def test_main_text(html, want):
    assert pages.main_text(html) == want


def test_open_blocks_inherit_from_the_nearest_decided():
    block = lambda text, parent=0: pages.Block(text, 0, False, 0, parent)
    bad = pages.Block("x", 0, True, 0, 9)
    labels = pages.classify([bad, block("a"), block("b", 1), block(TEXT, 1), block("c", 1), bad, block("d")])
    assert labels == [False, False, True, True, True, False, False]


RU = "Кошка сидела на коврике, и это был хороший день для всех людей, которые пришли посмотреть на неё в город."
ZH = "今天天气很好，许多人来到城里看那只坐在垫子上的猫，大家都觉得这是美好的一天，晚上才回家。"
NAMES = "Anna Berg, Otto Lindqvist, Mia Castellano, Jean Dupuis, Hugo Wirtz, Nora Quist, Ivo Marek"
MENU = "<div><a href=a>One</a> <a href=b>Two</a></div>"


@pytest.mark.parametrize(("html", "want"), [
    (f"<nav>x</nav>{MENU}<div><p>{RU}<p>{RU}</div>{MENU}<footer>{RU}</footer>", f"{RU}\n{RU}"),
    (f"<nav>x</nav><div><p>{ZH}<p>{ZH}</div><footer>y</footer>", f"{ZH}\n{ZH}"),
    (f"<nav>x</nav><div><p>{TEXT}</p><table><tr><td>{NAMES}<tr><td>{NAMES}<tr><td>{NAMES}</table></div><footer>y</footer>",
     "\n".join([TEXT] + [NAMES] * 3)),
    (f"<div><p>{TEXT}<p>{TEXT}</div><aside><article><p>{TEXT} Teaser.</article></aside>", f"{TEXT}\n{TEXT}"),
    (f"<div>{f'<p>{TEXT}' * 9}</div><article><p>Teaser</article>", "\n".join([TEXT] * 9 + ["Teaser"])),
    (f"<aside>buy<article><p>{TEXT}</article>", TEXT),  # never closed
    (f"<aside><article><p>{TEXT}</article></aside>", TEXT),  # all there is
])
def test_main_text_without_known_words_or_article(html, want):
    assert pages.main_text(html) == want


def test_pages_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", f"<article>{'<p>' + TEXT}" * 3_000)]
    found = pages.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(found.collect(), key=lambda r: r.n_chars)
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 0), (1, 1), (1, 1), (2, 3_000 * (len(TEXT) + 1) - 1)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------ mixing


def water(sizes, weights, ceiling):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        weight = sum(w[s] for s in names if s not in fixed)
        share = {s: left * w[s] / weight for s in names if s not in fixed}
        over = [s for s in share if share[s] >= ceiling * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed |= {s: ceiling * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def test_mix_meets_the_targets(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), "en", rng.choice(["a", "b", "c", "é", None, "zz"])) for i in range(800)]
    rows += [(900, "x " * 40_000, "en", "b"), (901, "y", "en", "tiny"), (902, None, "en", "tiny"), (903, "", None, "empty"),
             (5, rows[5][1], "en", rows[5][3]), (None, "a b", None, "a")]
    sizes, count = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
        count[s] += 1
    got = mixing.mix(clashing(documents(rows))).collect()
    want = water(sizes, mixing.WEIGHTS, 3)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        assert (r.position is None) == (r.copies == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5)
    again = mixing.mix(documents(rows[::-1]).repartition(3))
    keep = ("doc_id", "source", "taken", "copies", "position")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[k] for k in keep) for r in got), key=key) == sorted(
        (tuple(r) for r in again.select(*keep).collect()), key=key)


def test_takes_follow_the_curriculum(documents):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a", "b", "c"] * 300)]
    mixed = mixing.mix(documents(rows))
    takes = mixing.takes(mixed).collect()
    assert [r.position for r in takes] == sorted(r.position for r in takes)
    assert len(takes) == sum(r.copies for r in mixed.collect())
    early = Counter(r.source for r in takes if r.position < 0.5)
    total = Counter(r.source for r in takes)
    for s, tilt in zip("abc", mixing.TILTS, strict=True):  # integral of 1 + tilt (2t - 1) to 0.5
        assert early[s] / total[s] == pytest.approx(0.5 - tilt / 4, abs=0.02)


def test_mix_is_native_and_handles_nothing(documents):
    df = mixing.in_training_order(mixing.mix(documents([(1, "a b", "en", "s"), (2, None, "en", None)])))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct"))
    assert sorted((r.doc_id, r.taken) for r in df.collect()) == [(1, 2), (2, 0)]
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]


# ------------------------------------------------------------------ packing


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [
    None, "", " \n", "Hello, World!", "don't WE'LL you're it's", "a\tb\x0bc\x0cd\re  f", "ÀÉ é ŒUVRE straße ΣΑΣ",
    "the&&& of.,; <|endoftext|> (x) [y] 3.14 50%", "日本語 テキスト", "x" * 5_000, "word " * 9_000, "a b", "a b",
    "it's.", "'s", "l'été. d'un;", "naïve...   nbsp em", "1/2½Ⅷ x²", "\x1c\x1d", "é. ́a",
]


def test_words_encode_like_the_whole_text():
    encoder = packing.Encoder(TOKENIZER, limit=7)
    odd = TEXTS + ["hello<|endoftext|> bye", "<|startoftext|><|endoftext|>", "<|EndOfText|> a<|ENDOFTEXT|>", "a<|endoftext|", "É<|startoftext|>é"]
    for texts in ([t] for t in odd), [odd]:
        for some in texts:
            for text, ids, want in zip(some, encoder.ids(some), ids_of(some), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == want[:-1], text


def test_letters_without_the_normaliser_keep_their_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    encoder = packing.Encoder(TOKENIZER)
    assert encoder.model is not None
    texts = [
        "ABC, abc. Z a", "ab\u0301c abc\u0301.", "don't 'Re we\u2019ll </w> a</w>", "\u0130stanbul \u01c5 \u03a3\u0391\u03a3",
        "1a2b x1", "x" * 3000 + " y", "a\u0085b a\x1cb a\u3000b", "hello<|endoftext|> bye", "",
    ]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(documents):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["the", "of", "erre", "xyzzy"], k=rng.randint(1, 900))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, TEXTS[3])]
    got = packing.pack(packing.pieces(clashing(documents(rows)), TOKENIZER)).collect()
    want = dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.doc_tokens == len(want[p.doc_id])
        part = want[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc, parts in by_doc.items():
        times = 2 if doc == 3 else 1
        assert sum(n for _, n in parts) == times * len(want[doc])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(packing.pieces(documents([]), TOKENIZER)).count() == 0


def test_a_worker_keeps_no_words_between_tasks():
    import pyarrow as pa

    class Docs:
        """Runs the task's function here, to see what it leaves behind."""

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a word", None]})
            return [b.to_pydict() for b in function(iter([batch]))]

    class Column:
        def cast(self, kind):
            return self

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing.F, "col", lambda name: Column())
        [got] = packing.pieces(Docs(), TOKENIZER)
    assert got["doc_id"] == [1, 2] and got["length"][1] == 1
    assert not packing.encoder(TOKENIZER)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
    patterns = packing.plan(histogram, 64)
    placed = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    # Shortest pack first never opens a pack while one has room: at most one pack is
    # emptier than the shortest piece would need.
    table = packing.slots(patterns)
    covered = Counter()
    for length, first, _, _ in table.tolist():
        covered[length] = max(covered[length], first)
    assert set(covered) == set(histogram)


# ------------------------------------------------------------------ sharding


def test_equal_texts_share_a_shard_and_sizes_are_near(documents):
    rng = random.Random(4)
    texts = ["é" * rng.randint(0, 3_000) + str(rng.random()) for _ in range(900)] + ["copy " * 50] * 60 + [None, "", None, ""]
    texts += ["long" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "n")]
    got = sharding.shard(clashing(documents(rows)), 24).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    home, load, slots = {}, Counter(), defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == binascii.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert home.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < 24
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 24
    assert max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.98 * mean
    again = sharding.shard(documents(rows[::-1]).repartition(3), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shard(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_schedule_is_longest_processing_time(seed):
    import heapq

    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 500) for _ in range(300)), reverse=True)
    classes = [(z, n, z * n) for z, n in Counter(sizes).items()]
    dealt = sharding.schedule(classes, 7)
    loads = [0] * 7
    for z, takers, before in dealt:
        ends = [*before[1:], Counter(sizes)[z]]
        for s, a, b in zip(takers, before, ends, strict=True):
            loads[s] += z * (b - a)
    heap = [0] * 7
    for z in sizes:
        heapq.heapreplace(heap, heap[0] + z)
    assert sorted(loads) == sorted(heap)


def test_rounds_of_one_large_class_stay_even():
    (name, takers, before), = sharding.schedule([(10, 1_000_003, 10_000_030)], 24)
    counts = np.diff([*before, 1_000_003])
    assert name == 10 and takers == list(range(24)) and counts.max() - counts.min() <= 1


def test_size_classes(spark):
    sizes = [8, 2047, 2048, 2049, 2050, 10**6, 10**15 + 7]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", sharding.size_class(sharding.F.col("s")).alias("c"))
    for s, c in got.collect():
        assert c <= s and (c == s if s < 2048 else s - c < s / sharding.PRECISION * 1.01)


def test_mixing_equals_sql(spark, documents):
    from salesloom.llm.queries import ORACLE

    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", None])) for i in range(300)]
    df = documents(rows)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    names = "doc_id, size, source_size, target, taken, copies, position"
    want = sorted(con.execute(f"SELECT {names} FROM ({ORACLE['op8_mixing']})").fetchall())
    got = sorted(tuple(r) for r in mixing.mix(df).select(*names.split(", ")).collect())
    assert got == want
