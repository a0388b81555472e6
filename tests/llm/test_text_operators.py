"""Each text operator against a brute-force version on small tables, and on odd ones."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quotemill.llm import chat_format, common, decontaminate, html_extract, lm_scoring, packing, quality_rules, sharding, simhash_dedup, substring_dedup, toxicity

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
#: Extra columns, some named like what operators use inside.
DOCS = "doc_id long, text string, lang string, fp long, spans string, row_tag long, Bucket int, _doc long"


def words(text):
    return SPACE.findall((text or "").encode())


def odd_rows():
    r = random.Random(7)
    passage = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(50)) for _ in range(70))
    texts = [None, "", " \n\t ", "one", "two words", "a b c\x85d", passage, passage, f"before {passage} after", "x " * 300, "Ünïcode ßtraße — ñandú " * 20, "line one here\nline one here\nother line", "z" * 5000, "<|im_end|> <|endoftext|> text"]
    texts += [" ".join(r.choice("the of and to in that it is was for".split()) for _ in range(r.randrange(5, 150))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, passage), (None, None), (3, "one"), (3, "one"), (3, "another text of the same id")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1, "s", 2, 3, 4) for i, t in odd_rows()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_split_at_ascii_white_space_only():
    from quotemill.llm.common import words_of

    text = "a\x1cb\x85c d\x0be\x0cf\tg\r\nh  i\x00j"
    assert words_of(text.encode()) == words(text)


# ---- 1 ----

def brute_dedup(rows, window):
    big = 1 << 63
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), big - 1 if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (big - 1 if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"most": 1}, {"longest": 3}])
def test_substring_dedup(spark, options):
    r = random.Random(str(options))
    shared = [[r.choice("abcdefgh") for _ in range(r.randint(5, 40))] for _ in range(6)]
    rows = []
    for d in range(50):
        t = []
        for _ in range(r.randint(0, 5)):
            t += r.choice(shared)[r.randint(0, 3) :] if r.random() < 0.6 else [r.choice("abcdefgh") for _ in range(r.randint(0, 20))]
        rows.append((d, " ".join(["a"] * r.randint(1, 200) if r.random() < 0.1 else t)))
    got = substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), window=12, minimiser=3, **options).collect()
    assert Counter(tuple(x) for x in got) == brute_dedup(rows, 12)


def test_substring_dedup_odd(odd, none):
    want = brute_dedup(odd_rows(), 50)
    assert Counter(tuple(x) for x in substring_dedup.dedup_report(odd).collect()) == want
    kept = substring_dedup.remove_repeats(odd)
    assert kept.columns == odd.columns
    assert Counter((x.doc_id, hashlib.sha256(b" ".join(words(x.text))).hexdigest()) for x in kept.collect()) == Counter((d, h) for (d, _, _, h), n in want.items() for _ in range(n))
    assert substring_dedup.dedup_report(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [1, 8192])
def test_substring_dedup_repeated_rows(spark, most):
    r = random.Random(9)
    phrases = [[r.choice("abcdefgh") for _ in range(r.randint(15, 40))] for _ in range(4)]
    rows = []
    for d in range(30):
        t = [r.choice("abcdefgh") for _ in range(r.randint(0, 20))] + r.choice(phrases) + [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        rows += [(None if d % 7 == 6 else d, " ".join(t))] * r.randint(1, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_report(docs, window=12, minimiser=3, most=most).collect()
    assert Counter(tuple(x) for x in got) == brute_dedup(rows, 12)
    odd = [x for x in odd_rows() for _ in range(2)]
    got = substring_dedup.dedup_report(spark.createDataFrame(odd, "doc_id long, text string"), most=most).collect()
    assert Counter(tuple(x) for x in got) == brute_dedup(odd, 50)


def test_substring_dedup_of_many_equal_rows(spark):
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") for _ in range(60))
    rows = [(5, text + " tail")] * 10_000 + [(k, f"head{k} {text}") for k in range(8)]
    docs = substring_dedup._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    want = docs.limit(1).select("doc", "row", F.array(F.struct(F.lit(1).cast("long").alias("key"), F.lit(2).cast("long").alias("content"), F.lit(3).cast("long").alias("place"), F.lit(2).cast("long").alias("size"))).alias("want"))
    assert substring_dedup._packed(docs, want, 50).count() == 1
    assert Counter(tuple(x) for x in substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_dedup(rows, 50)


# ---- 2 ----

def brute_pack(histogram, length):
    """Piece by piece, longest first, into the shortest open pack; what that does not take opens a pack each. How many packs have each fill."""
    packs = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            least = min((k for k, f in enumerate(packs) if f < length), key=packs.__getitem__, default=None)
            if least is None or packs[least] + size > length:
                break
            packs[least] += size
            left -= 1
        packs += [size] * left
    return Counter(packs)


def test_packing_pattern_counts():
    for s in range(100):
        r = random.Random(s)
        histogram = {x: r.randint(1, 30) for x in r.sample(range(1, 64), r.randint(1, 40))}
        made = packing.pack(histogram, 64)
        assert all(sum(x) <= 64 and n > 0 for n, x in made)
        assert Counter(f for n, x in made for f in [sum(x)] * n) == brute_pack(histogram, 64)
        total = Counter()
        for n, x in made:
            for size in x:
                total[size] += n
        assert total == histogram


def test_fast_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    r = random.Random(1)
    texts = [t or "" for _, t in odd_rows()] + ["".join(chr(r.randrange(0x20000)) for _ in range(r.randint(1, 12))).encode("utf-8", "ignore").decode() for _ in range(2000)]
    texts += ["".join(chr(r.choice([32, 10, 9, 39, 65, 97, 48, 0xE9, 0xDF, 0x4E2D, 0x1F600, 0xA0, 0x85, 33, 45])) for _ in range(r.randint(1, 80))) for _ in range(500)]
    assert packing.encoder(TOKENIZER)(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_odd(odd, none):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(odd, TOKENIZER, length=128).collect()
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    ids = [[*slow.encode(t or "", add_special_tokens=False).ids, 1] for _, t in odd_rows()]
    want = Counter((d, at, len(x[at : at + 128]), zlib.crc32(np.array(x[at : at + 128], "<u4").tobytes()), len(x)) for (d, _), x in zip(odd_rows(), ids, strict=True) for at in range(0, len(x), 128))
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 128


# ---- 3 ----

CHAT = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 2, "ann", "tie"), (1, None, None, "last"), (2, 0, "system", "alone"), (None, 0, "eve", "né"), (3, 600, "ann", "later"), (3, 1, "ann", "sooner")]


def brute_chat(rows, part):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is None, t or 0, re.sub(r"\s+", "_", (role or "unknown").replace("<|", "< |")), (text or "").replace("<|", "< |")))
    out = Counter()
    for c, said in by.items():
        said.sort()
        for who in {m[2] for m in said} - {"system"}:
            for k in range(0, len(said), part):
                whole, spans = "", []
                for _, _, role, text in said[k : k + part]:
                    whole += "<|im_start|>" + ("assistant" if role == who else "system" if role == "system" else f"user name={role}") + "\n"
                    if role == who:
                        spans.append((len(whole), len(whole) + len(text) + 10))
                    whole += text + "<|im_end|>\n"
                out[c, who, k // part, len(said[k : k + part]), whole, tuple(spans)] += 1
    return out


@pytest.mark.parametrize("part", [512, 2, 1])
def test_chat_format(spark, part):
    df = spark.createDataFrame([(*r, 9) for r in CHAT], "conv_id long, turn long, role string, text string, speaker int")
    got = Counter((r.conv_id, r.speaker, r.part, r.n_messages, r.text, tuple(map(tuple, r.spans))) for r in chat_format.dialogues(df, part=part).collect())
    assert got == brute_chat(CHAT, part)
    assert sum(r.trained for r in chat_format.messages(df).collect()) == 8
    assert chat_format.dialogues(df.limit(0), part=part).count() == 0


def test_chat_format_of_one_turn_or_none(spark):
    r = random.Random(3)
    rows = [(1, None, "ann", "same")] * 3000 + [(1, None, "bob", f"text {r.randrange(500)}") for _ in range(700)] + [(None, 1, r.choice("abc"), "t" * r.randrange(40)) for _ in range(900)] + [(2, 1, "eve", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = Counter((r.conv_id, r.speaker, r.part, r.n_messages, r.text, tuple(map(tuple, r.spans))) for r in chat_format.dialogues(df).collect())
    assert got == brute_chat(rows, 512) and max(k[3] for k in got) == 512


# ---- 4 ----

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and that is the way of it.</p></div>
<article><header class="entry-header"><h1>The  title &eacute;&#233;</h1></header><p>First <b>para</b>graph<br>of the text with a <a href="x">link</a> &lt;in&gt; it.<p>Open <p>Short.</p><!-- <p>no</p> --><div class="ad">Buy</div>
<form><label>Mail</label><input></form><aside>Side</aside><ul><li>one<li>two</ul></article><section id="comments"><p>I think that this is not the best of it.</p></section><footer>&copy; x &middot; y</footer></body></html>"""


def test_html_extraction(spark):
    want = "The title éé\nFirst paragraph of the text with a link <in> it.\nOpen\nShort.\none\ntwo"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")) == want
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>cut <b"), (5, "x", "<div" * 2000), (6, "y", "plain text"), (7, "z", "<p>a &amp b &am" + " c" * 100_000)]
    got = html_extract.extract_pages(spark.createDataFrame([(*p, "t", 0) for p in pages], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == want and by[2] == "" and by[None] == "" and by[6] == "plain text" and by[4] == "cut"
    assert by[7] == "a & b &am" + " c" * 100_000
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_rules_hold_on_marked_pages():
    dense = "It was the best of the times and it was the worst of them, as they had said to us in the house by the river. " * 4
    body = [f"{dense}{i}" for i in range(3)]
    # A small marked block does not discard the body, wherever that stands.
    for tag in ("<div>", '<div class="content">', "<section>"):
        page = f"{tag}{''.join(f'<p>{x}</p>' for x in body)}</{tag[1:].split()[0].strip('>')}><article><p>A teaser of some other piece.</p></article>"
        assert [" ".join(x.split()) for x in body] == html_extract.extract(page).split("\n")[:3]
    # Link density and neighbours decide inside the mark too.
    links = "".join(f'<p><a href="{i}">Another piece of the site, number {i}</a></p>' for i in range(3))
    page = f"<article><p>{dense}</p><p>Brief.</p><p>{dense}</p>{links}<p>More of it</p>{links}</article><p>Outside</p>"
    assert html_extract.extract(page).split("\n") == [dense.strip(), "Brief.", dense.strip()]


class PlainBlocks(HTMLParser):
    """Blocks of well-formed pages, by the library's parser: (text, characters in links, barred, inside, heading)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.stack, self.skip = [], [("", False, 0)], None
        self.fresh()
        self.feed(page)
        self.close()
        self.flush()

    def fresh(self):
        self.text, self.links, self.link, self.own, self.head = "", 0, False, False, False

    def flush(self):
        if joined := " ".join(self.text.split()):
            self.blocks.append((joined, min(self.links, len(joined)), self.stack[-1][1] or self.own, self.stack[-1][2], self.head))
        self.fresh()

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.links += len(" ".join(data.split())) if self.link else 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in html_extract.RAW_ELEMENTS | html_extract.DROPPED_ELEMENTS:
            self.skip = tag
            return
        self.text += " " if tag in ("br", "hr") else ""
        self.link = True if tag == "a" else self.link
        if tag not in html_extract.BLOCKS:
            return
        self.flush()
        written = "".join(f' {k}="{v or ""}"' for k, v in attrs)
        if tag in html_extract.CONTAINERS:
            if tag == "li" and "li" in [t for t, *_ in self.stack]:
                k = max(i for i, x in enumerate(self.stack) if x[0] == "li")
                if not any(t in ("ul", "ol", "menu") for t, *_ in self.stack[k:]):
                    del self.stack[k:]
            self.stack.append((tag, *html_extract._region(tag, written, *self.stack[-1][1:])))
        else:
            self.own, self.head = html_extract._region(tag, written, False, self.stack[-1][2])[0] if attrs else False, tag[0] == "h" and tag[1:].isdigit()

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = None if tag == self.skip else self.skip
            return
        self.link = False if tag == "a" else self.link
        if tag in html_extract.BLOCKS:
            self.flush()
            k = max((i for i, x in enumerate(self.stack) if x[0] == tag), default=0)
            if k and tag in html_extract.CONTAINERS:
                del self.stack[k:]


def plain_labels(blocks):
    """The two passes, block by block, with a walk to the nearest decided neighbours."""
    least = max((b.inside for b in blocks if not b.barred), default=0)
    where = [0 if not least else 1 if b.inside == least else 0 if b.inside else -1 for b in blocks]

    def first(b, w):
        share, n = b.links / len(b.text), len(b.text)
        if b.barred or share > 0.5 and not (w > 0 and share <= 0.8):
            return "bad"
        if share > 0.5:
            return "brief"
        if n < 70:
            return "bad" if share > 0.2 and w <= 0 else "brief"
        stops = html_extract.stop_density(b.text)
        if stops >= 0.2:
            return "good" if w > 0 or stops >= 0.3 and n > 200 else "near"
        if b.links:
            return "brief" if w > 0 else "bad"
        return "near" if n > 200 else "brief"

    one = [first(b, w) for b, w in zip(blocks, where, strict=True)]
    out = []
    for i, label in enumerate(one):
        if label in ("near", "brief"):
            def known(j, i=i):
                return one[j] in ("good", "bad") and not blocks[j].barred and (where[i] <= 0 or where[j] > 0 or one[j] == "good")

            before = next((j for j in range(i - 1, -1, -1) if known(j)), None)
            after = next((j for j in range(i + 1, len(blocks)) if known(j)), None)
            x, y = (None if j is None else one[j] for j in (before, after))
            if where[i] < 0:
                label = "good" if x == y == "good" else "bad"
            elif x is None and y is None:
                label = "good"
            elif x is None or y is None or x == y:
                label = x or y
                if where[i] > 0 and label == "bad" and None in (x, y) and not (blocks[i].heading and y == "bad"):
                    label = "good"
            elif label == "near":
                label = "good"
            elif blocks[i].heading:
                label = y
            else:
                label = "good" if i - before == after - i else x if i - before < after - i else y
        out.append(label == "good")
    return out


def test_html_against_a_plain_version():
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if x] + [PAGE]
    by = Counter()
    for page in pages:
        blocks = html_extract.blocks_of(page)
        assert [(b.text, b.links, b.barred, b.inside, b.heading) for b in blocks] == PlainBlocks(page).blocks
        assert html_extract.classify(blocks) == plain_labels(blocks)
        by.update(html_extract.passes(blocks))
    assert min(by["alone"], by["neighbours"]) > len(pages)  # both passes decide
    r = random.Random(6)
    words_of = {k: v.split() for k, v in html_extract.STOP_WORDS.items()} | {"none": [f"x{i}" for i in range(50)]}
    for _ in range(300):
        blocks = []
        for _ in range(r.randint(1, 12)):
            text = " ".join(r.choice(words_of[r.choice(["en", "de", "none"])]) for _ in range(r.choice([1, 5, 20, 60])))
            blocks.append(html_extract.Block(text, r.choice([0, 0, len(text) // 4, int(len(text) * 0.7), len(text)]), r.random() < 0.15, r.choice([0, 0, 1, 2]), r.random() < 0.2))
        assert html_extract.classify(blocks) == plain_labels(blocks)


@pytest.mark.parametrize("page", ["<a " * 333_000, "<script " * 125_000, "<div>" * 200_000, "<div " * 200_000, "<div>" * 100_000 + "</section>" * 50_000, "<a '<b \"" * 100_000, "<ul><li>" * 100_000, "<button>" * 100_000, "<!-- " * 200_000, "&#" + "9" * 900_000 + ";", "<p>x" * 200_000])
def test_html_time_follows_the_page(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 4
    assert html_extract.extract("<p>a&#0000000065;&#x110000;&#99999999999;<p>b" + page).startswith("aA��")


# ---- 5 ----

def brute_lm(rows, order=2):
    docs = [words(t) for _, t in rows]
    grams = lambda d, n: Counter(tuple(d[k : k + n]) for k in range(len(d) - n + 1))
    every = [sum((grams(d, n) for d in docs), Counter()) for n in range(1, order + 1)]
    total, out = sum(map(len, docs)), []
    for (i, _), d in zip(rows, docs, strict=True):
        own = [grams(d, n) for n in range(1, order + 1)]

        def seen(g, own=own):
            return every[len(g) - 1][g] - own[len(g) - 1][g]

        def score(g, n=len(d), seen=seen):
            if len(g) == 1:
                return (seen(g) or 0.5) / max(total - n, 1)
            return seen(g) / max(seen(g[:-1]), 1) if seen(g) else 0.4 * score(g[1:])

        out.append((i, len(d), round(sum(math.log(score(tuple(d[max(0, k - order + 1) : k + 1]))) for k in range(len(d))), 6)))
    return Counter(out)


@pytest.mark.parametrize(("order", "options"), [(2, {"block_bytes": 2000, "range_bytes": 5000}), (3, {}), (3, {"block_bytes": 500, "range_bytes": 300, "most_ranges": 4}), (1, {"block_bytes": 700, "range_bytes": 100, "most_ranges": 1})])
def test_lm_scoring(odd, none, order, options):
    got = lm_scoring.lm_scores(odd, order=order, **options).collect()
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == brute_lm(odd_rows(), order)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_scoring.lm_scores(none, **options).count() == 0


def test_lm_scoring_spreads_equal_rows(spark):
    rows = [(None, "one two three four five")] * 3000 + [(7, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = lm_scoring._deal(docs.withColumn("text", F.col("text").cast("binary")), 50, 2000).filter("doc_id is null").groupBy("block").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) < 600
    got = lm_scoring.lm_scores(docs, block_bytes=20_000, range_bytes=20_000).collect()
    assert len(got) == 3001 and len({(r.doc_id, round(r.log_score, 6)) for r in got}) == 2


# ---- 6 ----

def brute_fingerprint(text):
    w = (text or "").encode()
    w = SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in w))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_simhash_odd(spark, odd, none):
    prints = [brute_fingerprint(t) for _, t in odd_rows()]
    group = reach(set(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), p in zip(odd_rows(), prints, strict=True):
        if i is not None:
            least[group[p]] = min(least.get(group[p], i), i)
    want = Counter((i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(odd_rows(), prints, strict=True))
    got = simhash_dedup.near_duplicates(odd)
    assert Counter((r.doc_id, r.h, r.component_id) for r in got.select("doc_id", simhash_dedup.hex_of(F.col("fp")).alias("h"), "component_id").collect()) == want
    wide = simhash_dedup.near_duplicates(odd, wide_from=1)
    assert Counter((r.doc_id, r.h, r.component_id) for r in wide.select("doc_id", simhash_dedup.hex_of(F.col("fp")).alias("h"), "component_id").collect()) == want
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.values()))
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0


@pytest.mark.parametrize(("most", "wide"), [(1024, False), (3, False), (1, True), (1024, True), (2, True)])
def test_simhash_links(spark, most, wide):
    from quotemill.operators.components import components

    r = random.Random(5)
    prints = set()
    for _ in range(15):
        x = r.getrandbits(64)
        for _ in range(20):
            y = x
            for _ in range(r.randint(0, 6)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
    group = reach(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    size = Counter(group.values())
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most, wide)).collect()
    by = defaultdict(set)
    for row in got:
        by[row.component].add(row.node % (1 << 64))
    want = defaultdict(set)
    for x, g in group.items():
        if size[g] > 1:
            want[g].add(x)
    assert {frozenset(x) for x in by.values()} == {frozenset(x) for x in want.values()}


@pytest.mark.parametrize("most", [12, 2])
def test_near_copies_of_edited_texts(spark, none, most):
    from quotemill.llm import near_copies

    r = random.Random(4)
    rows = []
    for _ in range(8):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(150, 300))]
        for k in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(k and r.randint(1, 8)):
                w[r.randrange(len(w))] = f"x{r.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "one two", "One  two", "a b c d e f"])] + [rows[0], (None, rows[0][1])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for _, t in rows for w in [words((t or "").lower())]]
    group = reach(set(sets), lambda a, b: len(a & b) >= 0.8 * len(a | b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash_dedup.keep_one(docs, grouping=near_copies.near_copies, most=most)
    want = {}
    for (i, _), x in zip(rows, sets, strict=True):
        if i is not None:
            want[group[x]] = min(want.get(group[x], i), i)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(want.values())
    assert len(want) < simhash_dedup.keep_one(docs).count()  # 3 words and 3 bits leave edited copies
    assert simhash_dedup.keep_one(none, grouping=near_copies.near_copies).count() == 0


def shingle_sets(texts):
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for t in texts for w in [words((t or "").lower())]]


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize(("most", "near"), [(12, 4), (2, 1), (2, 0)])
def test_near_copies_in_large_buckets_lose_no_link(spark, most, near):
    """Documents on one template share bands without being near copies; the pairs among them are found whatever stands between."""
    from quotemill.llm import near_copies

    r = random.Random(11)
    template = [f"t{k}" for k in range(220)]
    texts = []
    for _ in range(60):
        own = template[:170] + [f"o{r.randrange(10**6)}" for _ in range(r.randint(25, 60))]
        for k in range(r.choice((1, 1, 2, 3))):
            w = list(own)
            for _ in range(k * 2):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(len(texts), ""), (len(texts) + 1, None), (0, texts[0]), (None, texts[1])]
    sets = shingle_sets(t for _, t in rows)
    group = reach(set(sets), alike)
    least = {}
    for (i, _), x in zip(rows, sets, strict=True):
        if i is not None:
            least[group[x]] = min(least.get(group[x], i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in near_copies.near_copies(docs, most=most, near=near).collect()}
    assert got == {(i, least[group[x]]) for (i, _), x in zip(rows, sets, strict=True)}
    assert len(set(least.values())) > 10


@pytest.mark.parametrize("wide_from", [1 << 26, 1])
def test_near_dedup_stage_links_by_simhash_too(spark, none, wide_from):
    """Fingerprints count repeats, sets of shingles don't: some pairs are near by the one only, some by the other, and groups are what both reach."""
    from quotemill.llm import near_copies

    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(6):
        base = prose(60) * 60
        first, second = base + prose(60), base + prose(60)
        edited = list(second)
        edited[-1] = "other"
        rows += [" ".join(x) for x in (first, second, edited)]
    plain = prose(200)
    rows += [" ".join(plain), " ".join(w if i % 66 != 50 else "x" for i, w in enumerate(plain)), " ".join(prose(90)), "", "  "]
    rows = list(enumerate(rows)) + [(99, None), (0, rows[0]), (None, rows[1])]
    sets = shingle_sets(t for _, t in rows)
    prints = [simhash_dedup.fingerprint((t or "").encode(), 5) for _, t in rows]
    bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    assert any(bits(3 * k, 3 * k + 1) in (1, 2, 3) for k in range(6)) and not any(alike(sets[3 * k], sets[3 * k + 1]) for k in range(6))
    assert bits(18, 19) > 3 and alike(sets[18], sets[19])
    group = reach(range(len(rows)), lambda i, j: alike(sets[i], sets[j]) or bits(i, j) <= 3)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[group[n]] = min(least.get(group[n], i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_copies(docs, simhash=True, wide_from=wide_from)
    assert got.columns == ["doc_id", "fp", "grouped", "component_id"]
    assert Counter((x.doc_id, x.component_id) for x in got.collect()) == Counter((i, least[group[n]]) for n, (i, _) in enumerate(rows))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(least.values()))
    assert corpus_pipeline.near_dedup_stage(spark, none, "").count() == 0


def test_links_by_prefix_are_all_links_between_groups(spark):
    from quotemill.llm import near_copies

    r = random.Random(5)
    sets = []
    for _ in range(25):
        base = r.sample(range(60), r.randint(1, 50))
        sets += [frozenset(base) - set(r.sample(base, min(len(base) - 1, k))) | {r.randrange(200) for _ in range(k)} for k in (0, 1, 2, 5)]
    sets = sorted(set(sets), key=sorted) + [frozenset()]
    rows = [(i, r.randrange(40), sorted(x)) for i, x in enumerate(sets)]
    got = near_copies.links_by_prefix(spark.createDataFrame(rows, "fp long, component long, set array<int>"), 0.8).collect()
    want = {(i, j) for i, ci, _ in rows for j, cj, _ in rows if i < j and ci != cj and alike(sets[i], sets[j])}
    assert want and sorted((x.a, x.b) for x in got) == sorted(want)


# ---- 7 ----

def brute_quality(text):
    w = words(text)
    n = len(w)
    grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    three = {i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    span, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= quality_rules.MIN_REPEAT:
            span |= set(range(i, i + best))
            longest = max(longest, best)
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < 50 or 100 * len(three) > 50 * n
    kept = not failed and len(span) <= quality_rules.MAX_COVERED * n and longest <= quality_rules.MAX_REPEAT
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(three), failed, kept, len(span), longest


def test_quality_odd(odd, none):
    got = Counter(tuple(r) for r in quality_rules.quality(odd).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in odd_rows())
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in odd_rows() if brute_quality(t)[6])
    assert quality_rules.quality(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_match_lengths():
    for s in range(150):
        r = random.Random(s)
        token, doc = [], []
        for d in range(r.randint(1, 4)):
            k, v = r.randint(0, 40), r.choice([1, 2, 3, 10])
            token += [r.randrange(v) for _ in range(k)]
            doc += [d] * k
        n, want = len(token), []
        for p in range(n):
            best = 0
            for q in range(n):
                k = 0
                while p != q and doc[p] == doc[q] and max(p, q) + k < n and doc[p + k] == doc[q + k] == doc[p] and token[p + k] == token[q + k]:
                    k += 1
                best = max(best, k)
            want.append(best if best >= 3 else 0)
        if n:
            assert quality_rules.match_lengths(np.array(token), np.array(doc)).tolist() == want


# ---- 8 ----

ITEMS = [(1, "What is the capital of that far and hilly land? It is the old town of Brakel by the river."), (2, "Name seven colours of the bow. Red orange yellow green blue indigo violet."), (3, None), (4, ""), (5, "tiny item"), (2, "Name seven colours of the bow. Red orange yellow green blue indigo violet."), (None, "An item without any number at all is still an item that can leak.")]


def test_block_max_wand_finds_all():
    r = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    items = [(i, w, w[-3:]) for i in range(50) for w in [[r.choice(vocabulary) for _ in range(r.randint(3, 15))]]]
    for threshold in (0.05, 0.3, 0.6):
        weights = []
        for _, w, _ in items:
            raw = {x: r.random() for x in set(w)}
            weights.append({x: v / sum(raw.values()) for x, v in raw.items()})
        index = decontaminate.Index(items, weights, threshold, block=4)
        for _ in range(100):
            have = r.sample(vocabulary, r.randint(1, 25))
            query = {index.terms[x] for x in have if x in index.terms}
            score = {n: sum(w.get(x, 0) for x in have) for n, w in enumerate(weights)}
            want = {n for n, s in score.items() if s >= threshold - 1e-9}
            assert {n for n, _ in index.search(query)} == want
            term = np.array(sorted(query), np.int64)
            assert not want or index.promising(term, np.zeros(len(term), np.int64), 1).tolist() == [0]


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    clean = " ".join(f"clean{i % 37} word of the text" for i in range(200))
    rows = [(1, f"{clean} {ITEMS[0][1].upper()} {clean}"), (2, ITEMS[1][1]), (3, clean), (4, "What is the capital of that far and hilly land?"), (5, None), (6, clean + " red orange yellow"), (None, ITEMS[6][1]), (2, ITEMS[1][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c0 int")
    for options in ({}, {"most_words": 5}):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, **options).collect())
        assert got == Counter({(1, 1): 1, (2, 2): 4, (None, None): 1})
        left = decontaminate.drop_leaks(docs, items, **options)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.drop_leaks(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.drop_leaks(odd, items).count() == len(odd_rows())


def brute_leaks(rows, items):
    """(doc_id, item_id) by every passage and item: BM25 as a share of the item's own, then both overlaps."""
    split = [(i, w, decontaminate.answer_words(t)) for i, t in items if (w := decontaminate.normal_words(t))]
    mean = sum(len(w) for _, w, _ in split) / len(split)
    freq = Counter(x for _, w, _ in split for x in set(w))
    out = Counter()
    for d, t in rows:
        words = decontaminate.normal_words(t)
        for i, w, answer in split:
            impact = {x: math.log(1 + (len(split) - freq[x] + 0.5) / (freq[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in Counter(w).items()}
            cell = 64
            while cell < len(w):
                cell *= 2
            size = min(5, len(w))
            grams = lambda y: {tuple(y[k : k + size]) for k in range(len(y) - size + 1)}  # noqa: B023, E731
            for at in range(0, max(1, len(words)), cell):
                passage = words[at : at + 2 * cell]
                score = sum(v for x, v in impact.items() if x in passage) / sum(impact.values())
                if score >= 0.6 - 1e-9 and len(grams(w) & grams(passage)) >= 0.8 * len(grams(w)) and len(set(answer) & set(passage)) >= 0.8 * len(set(answer)):
                    out[d, i] += 1
                    break
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, f"{prose(r.randint(8, 40))}. {prose(r.randint(2, 12))}.") for i in range(25)] + [(90, prose(150)), (91, prose(70) + ". " + prose(9))]
    rows = []
    for d in range(60):
        text = prose(r.randint(0, 250))
        for _, item in r.sample(items, r.randint(0, 3)):
            w = item.split()
            for _ in range(r.choice([0, 0, 1, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = f"{text} {' '.join(w)} {prose(r.randint(0, 90))}"
        rows.append((d, text))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    assert 20 < len(want) < 200
    for options in ({}, {"most_words": 60}, {"block": 2}):
        assert Counter((x.doc_id, x.item_id) for x in decontaminate.leaks(docs, table, **options).collect()) == want
    left = decontaminate.drop_leaks(docs, table, most_words=200)
    assert sorted(x.doc_id for x in left.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


def test_other_items_change_no_verdict(spark):
    half = [f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]
    item = (1, " ".join(half[0] + half[1]))
    apart = spark.createDataFrame([(1, " ".join(half[0] + [f"x{k}" for k in range(300)] + half[1])), (2, item[1])], "doc_id long, text string")
    for others in ([], [(2, " ".join(f"o{k}" for k in range(600)))]):
        items = spark.createDataFrame([item, *others], "item_id long, text string")
        assert [(x.doc_id, x.item_id) for x in decontaminate.leaks(apart, items).collect()] == [(2, 1)]


# ---- 9 ----

def test_toxicity_learns_and_restores(spark):
    r = random.Random(2)
    plain = "river stone garden window candle morning silver paper basket winter yellow market".split()
    bad = ["vileword", "nastyone"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(5, 40))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "river stone v1l3w0rd garden"), (1001, "paper n a s t y o n e market"), (1002, "silver vilewoooord window"), (1003, None), (1004, ""), (None, "river vileword"), (1005, "river stone w1nter garden")]
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    assert all(x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in (1000, 1001, 1002, None)] == [1, 1, 1, 1] and [got[i].predicted for i in (1003, 1004, 1005)] == [0, 0, 0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {x.score for x in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()} == {1 / (1 + math.exp(30))}


def reading_cost(cost, text, price):
    x, y = 0, 0
    for ch in text + " ":
        c = toxicity._CODE.get(ch, toxicity.OTHER)
        if c or y:
            price += float(cost[x, y, c])
            x, y = y, c
    return price


def test_viterbi_against_enumeration():
    from itertools import product

    for seed in range(60):
        r = random.Random(seed)
        cost = np.random.default_rng(seed).random((64, 64, 64)).astype(np.float32) * 4
        for raw in ("stuupid", "n1ce", "a.b", "f-ck", "h3ll00", "aaa", "a1!b", "s.t.u", "€uro5"):
            lattice = toxicity.word_lattice(raw)
            each = [[(0.0, p)] if isinstance(p, str) else r.sample(p, min(len(p), 4)) for p in lattice]
            got = toxicity.Restorer(cost).decode([p[0][1] if len(p) == 1 else p for p in each])
            every = {}
            for way in product(*each):
                text, price = "".join(t for _, t in way), sum(p for p, _ in way)
                every.setdefault(text.strip(), []).append(reading_cost(cost, text, price))
            best = min(min(v) for v in every.values())
            assert abs(min(every[got]) - best) < 1e-3


def test_disguises():
    r = random.Random(1)
    known = "stupid scum trash idiot people river garden little letter coffee summer yellow happy well known house".split()
    text = " ".join(r.choice(known) for _ in range(4000))
    c = toxicity.char_codes(" " + text + " ")
    counts = np.bincount(c[:-2] * 64 * 64 + c[1:-1] * 64 + c[2:], minlength=64**3)
    restorer = toxicity.Restorer(toxicity.char_model(counts.astype(float)))
    read = lambda t: " ".join(restorer.text(t))
    for raw in ("stuupid", "st*pid", "s-t-u-p-i-d", "s.t.u.p.i.d", "STUPIIID", "5tup1d", "$tupid", "s t u p i d", "s  t  u  p  i  d", "s\nt\nu\np\ni\nd", "s/ t/ u/ p/ i/ d"):
        assert read(raw) == "stupid", raw
    assert read("scu.m") == "scum" and read("tra-sh") == "trash" and read("s c u m   t r a s h") == "scum trash"
    assert read("well-known") == "well known" and read("little letter, coffee summer yellow") == "little letter coffee summer yellow"
    weights = toxicity.Weights({"stupid": 2.0}, restorer)
    assert weights.of_words(["stu", "pid,"]) == [2.0] and weights.of_words(["river", "garden"]) == []
    assert read("a b 1 2 | 3 4") and read("1 2 3") == "1 2 3" and read("2019 | 5") == "2019 5"


@pytest.mark.parametrize("text", ["_" * 1_000_000 + "=", "abcdefghij" * 100_000, "x" * 1_000_000, "_ " * 500_000 + "=", "a " + " ." * 500_000, "@" * 1_000_000, "ab1" * 30_000, "a-" * 100_000, "a " * 100_000])
def test_toxicity_time_follows_the_text(text):
    cost = np.random.default_rng(0).random((64, 64, 64)).astype(np.float32)
    began = time.process_time()
    toxicity.summary(text, toxicity.Weights({"stupid": 1.0}, toxicity.Restorer(cost)))
    assert time.process_time() - began < 4


def test_toxicity_learns_once_from_repeated_rows(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("river stone garden vileword".split() if i % 3 == 0 else "river stone garden".split()) for _ in range(12))) for i in range(120)]
    labels = spark.createDataFrame([(i, int("vileword" in t)) for i, t in rows], "doc_id long, toxic int")
    seen = []
    fitted = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(len(y)) or fitted(x, y))
    docs = spark.createDataFrame(rows + [rows[0]] * 10_000 + [(1, "another text")] * 50, "doc_id long, text string")
    got = toxicity.toxicity(docs, labels, train_rows=60).collect()
    assert len(got) == 10_170 and seen == [60] and len({x.score for x in got if x.doc_id == 0}) == 1
    one = toxicity.toxicity(docs.limit(20), labels.withColumn("toxic", F.lit(1))).collect()
    assert {x.predicted for x in one} == {1} and all(x.score > 0.99 for x in one)


# ---- 10 ----

def test_sharding(spark, odd, none):
    got = sharding.manifest(odd).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key") for i, t in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.manifest(none).count() == 0
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: (r.shard, r.grown) for r in sharding.assign(keys, grown="grown").collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(keys, weights=[1.0] * 41).collect()}
    assert all(g == after[k] and g in (s, 40) for k, (s, g) in before.items())
    size = Counter(r.shard for r in sharding.assign(keys, weights=[1.0, 3.0]).collect())
    assert 0.70 < size[1] / 4000 < 0.80


def test_shards_by_an_independent_hash(odd):
    for weights in ([1.0] * 40, [1.0, 2.5, 0.5]):
        def scores(key, n, weights=weights):
            h = xxhash.xxh64_intdigest(b"\0null" if key is None else str(key).encode(), 42)
            return [(-math.log(((xxhash.xxh64_intdigest(struct.pack("<i", k), h) >> 11) + 0.5) * 2.0**-53) / (weights[k] if k < len(weights) else 1.0), k) for k in range(n)]

        for x in sharding.manifest(odd, weights=weights).collect():
            assert (x.shard, x.grown_shard) == (min(scores(x.doc_id, len(weights)))[1], min(scores(x.doc_id, len(weights) + 1))[1])


def test_ranks_of_equal_rows(spark, none):
    from quotemill.llm import common

    rows = spark.createDataFrame([("a", 1)] * 10_000 + [("b", k) for k in range(500)], "group string, v int")
    table = common.shared(common.salted(rows, "salt", "v"), "ranks")
    buckets = table.filter("group = 'a'").groupBy((F.pmod("salt", F.lit(64))).alias("b")).count().collect()
    assert max(x["count"] for x in buckets) < 400
    got = common.ranks_in_groups(table, "group", "salt", "rank", per_bucket=100)
    assert got.columns == ["group", "v", "rank"]
    by = defaultdict(list)
    for x in got.collect():
        by[x.group].append(x["rank"])
    assert sorted(by["a"]) == list(range(10_000)) and sorted(by["b"]) == list(range(500))


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_join_of_hot_keys(spark, hot):
    """A key of over a third of the rows, some of one row, some that the table lacks; whichever of them count as hot, the rows are the same."""
    keys = [7] * 40 + [8] * 30 + list(range(100, 130)) + [9, 9]
    rows = common.shared(spark.createDataFrame(list(enumerate(keys)), "id long, k long").withColumn("own_key", F.col("id") * 2), "rows")
    known = {k: keys.count(k) for k in set(keys) - {9}}
    table = spark.createDataFrame([(k, n, str(k)) for k, n in known.items()], "k long, n long, what string")
    got = common.join_hot(rows, table, "k", "n", len(keys), hot)
    assert got.columns == ["id", "k", "own_key", "what"]
    assert sorted(map(tuple, got.collect())) == [(i, k, i * 2, str(k)) for i, k in enumerate(keys) if k != 9]
    assert common.join_hot(rows.limit(0), table.limit(0), "k", "n", 0, hot).count() == 0


def test_very_long_texts(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(4000)}" for _ in range(30_000))
    rows = [(1, long), (2, "before " + long[: len(long) // 2]), (3, "y" * 1_000_000), (4, " ".join(["same"] * 50_000)), (5, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in substring_dedup.dedup_report(docs).collect()) == brute_dedup(rows, 50)
    assert {x.doc_id: x.fp % (1 << 64) for x in simhash_dedup.near_duplicates(docs).collect()} == {i: brute_fingerprint(t) for i, t in rows}
    assert {x.doc_id: (x.n_words, x.kept) for x in quality_rules.quality(docs).collect()} == {1: (30_000, True), 2: (15_001, True), 3: (1, False), 4: (50_000, False), 5: (2, False)}
    assert Counter((x.doc_id, x.n_words, round(x.log_score, 4)) for x in lm_scoring.lm_scores(docs).collect()) == Counter((i, n, round(s, 4)) for (i, n, s) in brute_lm(rows))
    ids = packing.encoder(TOKENIZER)([t for _, t in rows])
    assert {x.doc_id: x.doc_tokens for x in packing.pack_documents(docs, TOKENIZER).collect()} == {i: len(x) + 1 for (i, _), x in zip(rows, ids, strict=True)}
    items = spark.createDataFrame([(9, long[-400:])], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, items).collect()] == [(1, 9)]
    assert len(sharding.manifest(docs).collect()) == 5


def test_write_shards(odd, tmp_path):
    sharding.write_shards(odd.drop("Bucket"), f"file://{tmp_path}/out", weights=[1.0] * 4, files_per_shard=2)
    assert odd.sparkSession.read.parquet(f"file://{tmp_path}/out").count() == len(odd_rows())


# ---- joins that few rows need ----

def test_parted_loses_no_row_and_sends_few(spark):
    from quotemill.llm.common import parted

    rows = spark.createDataFrame([(None if i % 50 == 7 else i % 400, f"t{i}") for i in range(1000)], "k long, slot_word string")
    table = spark.createDataFrame([(x, 0) for x in (3, 5, 5, 390, -1)], "own long, more int")
    for slots in (1 << 23, 128, 64):
        may, others = (sorted(map(tuple, x.collect()), key=str) for x in parted(rows, F.col("k"), table, F.col("own"), slots))
        assert sorted(may + others, key=str) == sorted(map(tuple, rows.collect()), key=str)
        assert not {k for k, _ in others} & {3, 5, 390}
        assert slots == 64 or len(may) < 200
        assert slots < 1000 or {k for k, _ in may} == {3, 5, 390}
    may, others = parted(rows, F.col("k"), table.limit(0), F.col("own"))
    assert may.count() == 0 and others.count() == 1000


# ---- pipeline ----

def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, item = prose(60), prose(30)
    texts = [prose(r.randint(60, 200)) for _ in range(40)]
    texts += [texts[0], f"{prose(70)} {passage} {prose(10)}", f"{prose(70)} {passage} {prose(20)}", f"{prose(90)} {item} {prose(50)}", "too short", "same line again\n" * 60]
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    left = [(i, t) for i, t in enumerate(texts) if brute_quality(t)[6]]
    assert {44, 45} & {i for i, _ in left} == set()
    group = reach({brute_fingerprint(t) for _, t in left}, lambda a, b: (a ^ b).bit_count() <= 3)
    seen, rest = set(), []
    for i, t in left:
        if group[brute_fingerprint(t)] not in seen:
            seen.add(group[brute_fingerprint(t)])
            rest.append((i, t))
    assert 40 not in {i for i, _ in rest}
    sizes = {d: (n - gone, h) for d, n, gone, h in brute_dedup(rest, 50)}

    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        names.append(name)
        if name == "quality_rules":
            assert sorted(x.doc_id for x in docs.collect()) == [i for i, _ in left]
        if name == "simhash_near_dedup":
            assert sorted(x.doc_id for x in docs.collect()) == [i for i, _ in rest]
        if name == "substring_dedup":
            assert {x.doc_id: (len(words(x.text)), hashlib.sha256(b" ".join(words(x.text))).hexdigest()) for x in docs.collect()} == sizes
            assert all(x.n_chars == len(x.text) for x in docs.collect())
        if name == "benchmark_decontamination":
            assert sorted(x.doc_id for x in docs.collect()) == [i for i, _ in rest if i != 43]
        assert name == "packing" or docs.columns == columns
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
