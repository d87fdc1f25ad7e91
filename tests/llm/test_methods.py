"""The methods against plain implementations, without Spark."""

import itertools
import math
import random
import re
from re import _parser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from selenite.llm import bpe, cdc, crf, ego_join, html_blocks, licenses, ppm, sharding, simhash, tiling
from tests.conftest import SF

ODD = [
    "", "  ", "Hello's WORLD 123 <|endoftext|> it'S <|startoftext|>x", "ΑΣ ΑΣΒ İstanbul", "日本語テキスト　全角", "x" * 3000 + " ab" * 50,
    "\x1c\x1da b\x1e", "🙂🙃 foo", "don't!!! ''s '' 'tis", "ﬁ Å K", "\u0085 x", "<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(merges):
    words = [b"hello", b"world", b"the", b"there", b"a", b"foo"]
    codec = bpe.Codec(merges, bpe.compile_lexicon(words, merges.merge(words)))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = codec.encode(ODD)
    for text, row, decoded in zip(ODD, rows, codec.decode(rows), strict=True):
        ids = np.frombuffer(row, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact(merges):
    words = [a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing")]
    lexicon = bpe.compile_lexicon(words, merges.merge(words))
    codec = bpe.Codec(merges, lexicon)
    assert codec.ranks(words + [b"walke", b"x", b""]).tolist() == [sorted(words).index(w) for w in words] + [-1, -1, -1]
    suffixes = {tuple(sorted(w[i:] for w in words if w.startswith(p))) for w in words for i in range(len(w) + 1) for p in [w[:i]]}
    assert len(lexicon["go"]) - 1 == len({frozenset(x[len(p) :] for x in words if x.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))})
    assert suffixes


def test_merging_many_equals_one_at_a_time(merges):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdest", k=rng.randint(1, 40))).encode() for _ in range(300)]
    assert [list(x) for x in merges.merge(words)] == [merges.merge_one(w) for w in words]


def trie_counts(texts, context, longest):
    """What follows a context: occurrences under the longest, numbers of longer contexts under the others."""
    seen = {}
    for t in texts:
        x = b"\xff" * 5 + t + b"\xfe"
        for i in range(5, len(x)):
            if x[i - len(context) : i] == context:
                seen.setdefault(x[i], []).append(x[i - len(context) - 1 : i])
    return {s: len(v) if longest else len(set(v)) for s, v in seen.items()}


def trie_probability(texts, context, symbol):
    p, out = 1.0, set()
    for k in range(5, -1, -1):
        seen = trie_counts(texts, context[5 - k :], k == 5)
        n, d = sum(v for s, v in seen.items() if s not in out), sum(s not in out for s in seen)
        if not n:
            continue
        if symbol in seen and symbol not in out:
            return p * (seen[symbol] - 0.5) / n
        p *= d / (2 * n)
        out |= set(seen)
    kinds = {b for t in texts for b in t + b"\xfe"}
    return p / (255 - len(kinds))


def ppm_score(train, text):
    """log10 probability of a coded text: words behind 16 bytes by what followed these, the rest byte by byte."""
    edges = {}
    for t in train:
        places = [0, *(i + 1 for i in range(len(t)) if t[i] == 32)]
        for a, b in zip(places, [*places[1:], len(t) + 1]):
            if a >= 16:
                follows = edges.setdefault(t[a - 16 : a], {})
                word = (t + b"\xfe")[a:b]
                follows[word] = follows.get(word, 0) + 1
    counts = [n for f in edges.values() for n in f.values()]
    discount = (counts.count(1) + 1) / (counts.count(1) + 2 * counts.count(2) + 2)
    total, padded = 0.0, b"\xff" * 5 + text + b"\xfe"
    places = [0, *(i + 1 for i in range(len(text)) if text[i] == 32)]
    for a, b in zip(places, [*places[1:], len(text) + 1]):
        if a >= 16 and text[a - 16 : a] in edges:
            follows, word = edges[text[a - 16 : a]], (text + b"\xfe")[a:b]
            if word in follows:
                total += math.log10((follows[word] - discount) / sum(follows.values()))
                continue
            total += math.log10(discount * len(follows) / sum(follows.values()))
        total += sum(math.log10(trie_probability(train, padded[i : i + 5], padded[i + 5])) for i in range(a, b))
    return total


def test_ppm_predictions_equal_a_trie():
    train, other = [b"abab abc ", b"abcd ", b""], [b"abd zz "]
    key, count = ppm.counted(train + other, [True] * 3 + [False], lambda x: ppm.grams(x).astype(np.uint64))
    key = key.astype(np.int64)
    held = key[count > 0]
    one, two = {k & 0xFFFF for k in held.tolist()}, {k & 0xFFFFFF for k in held.tolist()}
    three = {k & 0xFFFFFFFF for k in held.tolist()}
    k2 = {g: sum(q & 0xFFFFFF == g for q in three) for g in two}
    k1 = {g: sum(q & 0xFFFF == g for q in two) for g in one}
    short = {"one": np.zeros((256, 256))} | {c: np.zeros(1 << 16) for c in ("n2", "d2", "x1")}
    for k, n in k1.items():
        short["one"][k >> 8, k & 255] = n
    for k, n in k2.items():
        short["n2"][k >> 8] += n
        short["d2"][k >> 8] += 1
        short["x1"][k >> 8] += k1[k & 0xFFFF]
    after_two = np.array([k2.get(k & 0xFFFFFF, 0) for k in key.tolist()], float)
    got = ppm.predictions(key, count, after_two, short)
    for k, p in zip(key.tolist(), got, strict=True):
        gram = k.to_bytes(6, "big")
        assert p == pytest.approx(math.log10(trie_probability(train, gram[:5], gram[5])))


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)).encode()
    pieces = lambda t: [t[a:b] for a, b in itertools.pairwise([0, *cdc.cuts(t)])]
    moved = b"an insertion at the front " + text[:900] + b" and one inside " + text[900:]
    assert b"".join(pieces(moved)) == moved and cdc.cuts(b"") == []
    assert len(set(pieces(text)) & set(pieces(moved))) > 0.8 * len(pieces(text))
    data = np.frombuffer(text, np.uint8)
    h, slow = 0, []
    for b in data:
        h = ((h << 1) + int(cdc.GEAR[b])) & 0xFFFF
        slow.append(h)
    assert cdc.gear_hash(data)[20:].tolist() == slow[20:]


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([5, 0, 17, 3], sharding.even(25, 4), 1)
    assert m.sum(1).tolist() == [5, 0, 17, 3] and m.sum(0).tolist() == [7, 6, 6, 6] and (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    draws = [sharding.communication_matrix([6, 4], [5, 5], s)[0, 0] for s in range(2000)]
    for k in range(1, 6):
        want = math.comb(5, k) * math.comb(5, 6 - k) / math.comb(10, 6)
        assert abs(draws.count(k) / 2000 - want) < 0.05


def test_pages():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now at once</div><article><header><h1>Head &amp; tail</h1></header>
    <p>First <b>bold</b>   words &lt;here&gt; and <a href="x>y">a link</a> more.<p>Second&nbsp;one<br>goes on.<aside>side</aside></article>
    <div class="comments"><p>I think that this is a long comment by a reader of the page.</p></div><form>mail <input></form><footer>&copy; us</footer>"""
    assert html_blocks.main_texts([page, "", "<p", "<div><"]) == ["Head & tail First bold words <here> and a link more. Second one goes on.", "", "", ""]


def test_page_without_article_keeps_long_blocks():
    body = "<p>" + "word " * 60 + "</p>"
    assert html_blocks.main_texts([f"<ul><li><a>one</a></li></ul><div>{body}{body}</div><footer>end</footer>"]) == [("word " * 120).strip()]


PROSE = "This is the main text of the page, which tells of many things and goes on for a while, as texts do."
PAGES = [
    # a teaser in an article, the text outside of any
    (f"<article><a href=x>Other</a></article><div id='content'><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p></div>", f"Title of it {PROSE} {PROSE}"),
    # names that only hold a frame word
    (f"<div class='layout-sidebar-left'><nav><a>Home</a></nav><h1>Head line</h1><p>{PROSE} {PROSE}</p></div>", f"Head line {PROSE} {PROSE}"),
    (f"<div class='post search-friendly'><h1>Head</h1><p>{PROSE} {PROSE}</p></div>", f"Head {PROSE} {PROSE}"),
    (f"<article><h1>T</h1><p>{PROSE}</p><div class='related-work'>{PROSE}</div><div class='related-posts'>More to read</div></article>", f"T {PROSE} {PROSE}"),
    # a frame by name that holds the page's heading
    (f"<div class='sidebar'><h1>Head</h1><p>{PROSE} {PROSE}</p><div class='share-buttons'>Tell it on</div></div>", f"Head {PROSE} {PROSE}"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x</annotation></math> be ten.</p></article>", "Let x=2 be ten."),
    (
        f"<header><h1>Site</h1></header><article><header><h1>Real</h1></header><p>{PROSE}</p></article><section id=comments><p>I liked {PROSE}</p>"
        f"<form><label>Say</label></form></section><div class='cookie-banner'>We use {PROSE}</div><footer>x</footer>",
        f"Real {PROSE}",
    ),
    (
        f"<ul><li><a>Home</a><li><a>News</a></ul><h1>Big news</h1><p>{PROSE} {PROSE}</p><h2>Sub</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>"
        "<ul><li><a>prev</a><li><a>next</a></ul><p>All kept by us</p>",
        f"Big news {PROSE} {PROSE} Sub {PROSE} Short one. {PROSE}",
    ),
]


PAGES += [
    # text without markup, and next to none
    ("Hello world.", "Hello world."), ("<p>Hello world.</p>", "Hello world."), ("Plain text, no markup,\n two lines.", "Plain text, no markup, two lines."),
    # forms around the whole page
    (f"<form id='aspnetForm'><nav><a>Home</a></nav><div><p>{PROSE}</p><p>{PROSE}</p></div><div class='site-footer'>(c) us</div></form>", f"{PROSE} {PROSE}"),
    (f"<main><form><p>{PROSE}</p></form></main>", PROSE),
    (f"<div class='sidebar'><p>{PROSE}</p><p>{PROSE}</p></div><form>Your mail <button>Go</button></form>", f"{PROSE} {PROSE}"),
    # paragraphs of an article with a frame's name; adverts and readers' words by other names
    (f"<article><h1>T</h1><p class='legal'>{PROSE}</p><p class='copyright'>It is ours.</p></article>", f"T {PROSE} It is ours."),
    (f"<article><p>{PROSE}</p><div class='content-ad'>{PROSE}</div><ins class=adsbygoogle>{PROSE}</ins><div data-ad-slot=1>Buy</div></article>", PROSE),
    (f"<article><p>{PROSE}</p></article><section class='responses'><p>{PROSE}</p></section><div class='user-reviews'><p>{PROSE} {PROSE}</p></div>", PROSE),
    (f"<div class='comments'><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p>", PROSE),
    # short items of a list outside of any article
    (f"<p>{PROSE}</p><ul><li>One</li><li>Two words</li><li>Three</li></ul><p>{PROSE}</p>", f"{PROSE} One Two words Three {PROSE}"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_odd_pages(page, text):
    assert html_blocks.main_texts([page]) == [text]


def test_tree_reads_words_and_links_of_the_neighbours():
    def fields(tree):
        return {html_blocks.FIELDS[tree[0]]} | fields(tree[2]) | fields(tree[3]) if isinstance(tree, tuple) else set()

    assert {"words", "links", "links_before", "words_after"} <= fields(html_blocks.trained())


def test_tree_splits_by_text_first_and_tells_given_pages_without_their_tags():
    tree = html_blocks.trained()
    assert all(t[0] < html_blocks.TEXT_FIELDS for t in (tree, tree[2]))
    right = words = by_tags = 0
    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
        page = page or ""
        want = html_blocks.blocks(page)[0]
        bare = re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", page)
        found = html_blocks.features(*html_blocks.blocks(bare))
        kept = html_blocks.classify(found, tree)
        assert len(found) == len(want)
        for b, k, f in zip(want, kept, found):
            words += b.words
            right += b.words * (k == (b.article >= 0))
            by_tags += b.words * ((f[6] == 1 and f[7] == 0) == (b.article >= 0))
    assert right > 0.97 * words and by_tags < 0.3 * words  # the tags alone would lose the text


def test_tree_agrees_with_its_table():
    table = np.array([line.split() for line in html_blocks.LABELLED.strip().splitlines()], float)
    assert (html_blocks.classify(table[:, :-1], html_blocks.trained()) == (table[:, -1] == 1)).all()


def test_pages_of_many_kinds_equal_a_plain_reading():
    """Pages drawn with their main text known: every frame goes, all of the article stays."""
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(["ant", "bee &amp; wasp", "caf\u00e9", "d&eacute;j\u00e0", "elk", "x &lt; y"]) for _ in range(n))
    plain = lambda s: s.replace("&amp;", "&").replace("&eacute;", "\u00e9").replace("&lt;", "<")
    frames = [
        "<nav><ul><li><a href=1>{}</a></li></ul></nav>", "<aside>{}</aside>", "<div class='ad'>{}</div>", "<div id=cookie-notice>{}</div>", "<form>{}</form>",
        "<script>var a='<p>{}</p>'</script>", "<style>p{{}} /* {} */</style>", "<!-- {} -->", "<section class='comments'><p>{}</p></section>", "<footer>{}</footer>",
    ]
    for _ in range(200):
        wanted, page = [], ""
        for f in rng.choices(frames, k=3):
            page += f.format(sentence(rng.randint(1, 30)))
        page += "<article>"
        for tag in rng.choices(["p", "h2", "li", "blockquote", "td"], k=6):
            s = sentence(rng.randint(1, 60))
            wanted.append(plain(s))
            page += f"<{tag}>\n  {s.replace(' ', '  ', 1)} </{tag}>" + (rng.choice(frames).format(sentence(8)) if rng.random() < 0.4 else "")
        page += "</article>" + rng.choice(frames).format(sentence(20))
        assert html_blocks.main_texts([page]) == [" ".join(wanted)]


def test_variant_keys_share_every_close_pair():
    rng = random.Random(4)

    def keys(mark):
        out = set()
        for low, mask, gap, piece, piece_mask, bits, tag in simhash.key_table(4):
            t = ((mark << (64 - low)) | (mark >> low)) & (2**64 - 1) if low else mark
            p = t & mask
            p = p if gap < 0 else ((p >> (gap + 1)) << gap) | (p & ((1 << gap) - 1))
            out.add(tag | (p << bits) | ((t >> piece) & piece_mask))
        return out

    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert keys(a) & keys(b)


def test_tiles_catch_reordered_passages():
    item = b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = tiling.Bench([(7, item), (8, b"only three words")], 5)
    words = item.split()
    turned = b"x y z " + b" ".join(words[7:]) + b" and then, " + b" ".join(words[:7]).upper() + b" q"
    assert bench.best(turned) == (1.0, 7, 2, 1)
    assert bench.best(b" ".join(words[:4])) == (0.0, None, 0, 0)
    assert bench.best(b"has only three words in it")[:2] == (1.0, 8)
    assert bench.best(b"") == (0.0, None, 0, 0)


def plain_tiles(text, item, least):
    """Mark the longest run of unmarked words that both share, again and again."""
    in_text, in_item, out = set(), set(), []
    while True:
        best = None
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and p + n not in in_text and q + n not in in_item:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        p, q, n = best
        in_text.update(range(p, p + n))
        in_item.update(range(q, q + n))
        out.append(best)


def test_tiles_equal_plain_tiling():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.choice("abcdefgh").encode() for _ in range(rng.randint(1, 30))]
        parts = [item[i : i + 7] for i in range(0, len(item), 7)]
        rng.shuffle(parts)
        text = [w for part in parts for w in (*part, *([b"zz"] * rng.randint(0, 2)))] + rng.choices(item, k=6)
        bench = tiling.Bench([(1, b" ".join(item))], 3)
        found = bench.hits(bench.numbers(text)).get(0, {})
        want = plain_tiles(text, item, min(3, len(item)))
        assert sorted(tiling.tile(found)) == sorted(want)
        assert bench.best(b" ".join(text))[0] == pytest.approx(sum(n for _, _, n in want) / len(item))


def test_tiles_never_overlap():
    rng = random.Random(3)
    for _ in range(50):
        text, item = ([rng.choice("abc") for _ in range(n)] for n in (40, 20))
        seeds = {(p, q): 3 for p in range(38) for q in range(18) if text[p : p + 3] == item[q : q + 3]}
        tiles = tiling.tile(seeds)
        covered = [q + i for _, q, n in tiles for i in range(n)]
        assert len(covered) == len(set(covered))
        assert all(text[p : p + n] == item[q : q + n] and n >= 3 for p, q, n in tiles)
        lengths = [n for _, _, n in tiles]
        assert lengths == sorted(lengths, reverse=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, chain = rng.normal(size=5), rng.normal(size=6)
    pair = chain[2:].reshape(2, 2)
    total, good = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        s = sum(e[i] for i in range(5) if y[i]) + chain[0] * y[0] + chain[1] * y[-1] + sum(pair[a, b] for a, b in itertools.pairwise(y))
        total += math.exp(s)
        good += math.exp(s) * np.array(y)
    got, counts = crf.marginals(e, np.array([0, 5]), chain)
    assert np.allclose(got, good / total) and counts[2:].sum() == pytest.approx(4)


def test_crf_learns_bad_lines():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(6))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(9)) for _ in range(5))
    texts, labels = [f().encode() for _ in range(60) for f in (good, bad)], np.array([1, 0] * 60)
    model = crf.train(texts, labels)
    s = crf.scores([good().encode(), bad().encode(), b"", b"\n\n"], model)
    assert s[0] > 0.8 and s[1] < 0.2 and ((s >= 0) & (s <= 1)).all()
    assert crf.scores([b"x"], crf.train([], np.array([])))[0] == 0.5


def test_vector_blocks_equal_all_pairs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(4, 16)), 40, 0) + rng.normal(scale=0.1, size=(160, 16))])
    norm = np.sqrt((x * x).sum(1))
    want = (x @ x.T) / np.outer(norm, norm) >= 0.9
    np.fill_diagonal(want, False)
    side = math.sqrt(0.2) + 1e-9
    axes = np.linalg.eigh(np.cov(ego_join.unit(x).T))[1][:, ::-1][:, :8]
    links = np.zeros(len(x), int)
    for parts in ([x[:200]], [x[200:]], [x[:200], x[200:]]):
        ids = [np.arange(200), np.arange(200, len(x))]
        own = ids if len(parts) == 2 else [ids[0] if len(parts[0]) == 200 else ids[1]]
        node, n, u, v = ego_join.block_links(own, [np.ones(len(i), int) for i in own], parts, axes, 0.9, side)
        np.add.at(links, node, n)
        assert all(want[a, b] for a, b in zip(u, v, strict=True))
    assert links.tolist() == want.sum(1).tolist()


def spellings(expression):
    """All strings that an expression of literals, choices and optional parts matches."""

    def strings(items):
        out = [""]
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    more = [chr(arg)]
                case "IN":
                    more = [chr(low if str(kind) == "LITERAL" else low[0]) for kind, low in arg]
                case "BRANCH":
                    more = [s for branch in arg[1] for s in strings(branch)]
                case "ANY":
                    more = ["x"]
                case "SUBPATTERN":
                    more = strings(arg[3])
                case "MAX_REPEAT":
                    more = [""] * (arg[0] == 0) + ["".join(x) for x in itertools.product(strings(arg[2]), repeat=max(1, arg[0]))]
            out = [a + b for a in out for b in more]
        return out

    return strings(_parser.parse(expression))


def license_names():
    """(label, keywords, expression) of every rule without its grant."""
    granted = [(x, k, f"licensed under (?:the )?{e}") for x, k, e in licenses.GRANTED]
    return [*licenses.FAMILIES, *licenses.versions(), *licenses.SHORT, *granted, *licenses.WORDINGS, *(n[:3] for n in licenses.NOTICES)]


def test_every_spelling_of_a_license_passes_the_trigger():
    trigger = re.compile(licenses.TRIGGER)
    names = [s for _, _, e in license_names() for s in spellings(e)]
    assert [s for s in [*names, *licenses.BASE] if not trigger.search(s)] == []


def test_every_spelling_of_a_license_holds_a_keyword():
    names = [(set(k.split()), s) for _, k, e in license_names() for s in spellings(e)]
    assert [s for keys, s in names if not keys & set(re.sub("[()]", "", s).split())] == []


def test_wordings_hold_their_own_words():
    """A wording is given as the words of a text: A-Z lowered, without punctuation."""
    for _, _, e in licenses.WORDINGS:
        for one in spellings(e)[:50]:
            assert re.findall(licenses.WORD, one) == one.split(" "), one
