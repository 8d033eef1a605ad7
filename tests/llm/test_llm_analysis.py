"""Filter audit, main-text extraction, conversation trie, and what is read back from formatted chats."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from telemill.llm import chat, conversation_trie, filter_audit, html_extract, minhash

# --- filter audit ---

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = WORDS.findall(text)
        failed = [len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                  100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
                  i is not None and i > least[text]]
        yield i, part or "", {x for x, f in zip("ABCDE", failed) if f}


def brute_audit(rows, labels):
    docs = [(part, failed, (1 in {q for j, q, _ in labels if j == i and i is not None}),
             (1 in {t for j, _, t in labels if j == i and i is not None})) for i, part, failed in failures(rows)]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [d for d in mine if x in d[1] and not d[1] & before]
                out[part, "".join(order), step] = [
                    sum(not d[1] & (before | {x}) for d in mine), len(gone),
                    sum(x in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {x} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = frame.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    long_ = " ".join(f"w{i}" for i in range(130))
    texts = [None, "", " \t\x0b", "A B C", "# plain", long_, long_ + " #", "same word " * 80, "LOUD " * 120, long_.upper(), "ÀÉ " * 110]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(None, long_, "en"), (None, long_, "en"), (7, "twice", "en"), (7, "twice", "de"), (900, "twice", "en"), rows[3], rows[3]]
    rows += [(1000 + i, long_ + " #", "xx") for i in range(40)]  # one large group of copies
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, True) for r in rows],
                                 "doc_id long, text string, lang string, part string, mask int, digest string, n int, good boolean")
    marks = spark.createDataFrame([(*r, "x", 0) for r in labels], "doc_id long, quality int, toxic int, lang string, id int")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert audit_rows(filter_audit.audit(docs.repartition(5), marks)) == brute_audit(rows, labels)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    none = audit_rows(filter_audit.audit(docs, marks.limit(0)))
    assert all(v[4] == v[5] == 0 for v in none.values()) and len(none) == 120 * 5 * 4


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "p"), (2, "b", "p"), (3, "c", "p")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit_rows(filter_audit.audit(docs, marks, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")}))
    assert found == {("p", "xy", 1): (2, 1, 0, 0, 0, 0, 1), ("p", "xy", 2): (1, 1, 1, 1, 0, 0, 3),
                     ("p", "yx", 1): (1, 2, 0, 1, 0, 0, 3), ("p", "yx", 2): (1, 0, 1, 0, 0, 0, 1)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, marks, {"long": F.lit(True)})


# --- pages ---

STORY = "This is the first paragraph of the story, and it has quite a lot of the words that any reader would expect to see. " * 2
PAGE = f"""<!doctype html><html><head><title>T &amp; x</title><style>p{{}}</style>
<script>if(a<b){{document.write("<p>no</p>")}}</script></head><body class="has-sidebar"><header><h1>Site</h1><a href="/">home</a></header>
<div id="cookie-notice"><p>We use cookies to make the site better for you and for all of us, and that is why you have to accept.</p></div>
<nav class="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<main><article><header><h1>Headline</h1></header><p>{STORY}</p><p>Short&nbsp;one<br>goes  on &lt;here&gt; &#8364; &amp;amp;</p>
<div class="advert">Buy <span>now</span></div><p>{STORY}<a href=x>a link</a></p><span class="ad">x<span>y</span>z</span>
<form><label>Your name</label></form><ul class="shareButtons"><li><a href=t>Tweet</a></li></ul>
<section id="comments"><h2>Comments</h2><article><p>{STORY} I think that you are wrong</p></article></section></article></main>
<aside><p>{STORY}</p></aside><footer>&copy; 2024 &middot; all rights</footer></body></html>"""


def test_marked_page():
    assert html_extract.main_text(PAGE) == "\n\n".join(
        ["Headline", STORY.strip(), "Short one goes on <here> € &amp;", STORY.strip() + " a link"])


def test_page_without_marks():
    page = f"""<html><body><div><a href=/>Home</a> | <a href=/x>News</a></div><div><h2>A headline</h2><p>{STORY}<p>Short.<p>{STORY}</div>
        <div>Terms <a href=t>x</a> &copy; 2020</div>"""
    assert html_extract.main_text(page) == "\n\n".join(["A headline", STORY.strip(), "Short.", STORY.strip()])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p", ""), ("<", "<"), ("a < b", "a < b"), ("<p>x</ p>y", "xy"),
    ("<!-- open", ""), ('<a href="x', ""), ("<p>&#0;&bogus;", "�&bogus;"), ("<script>x", ""), ("<article>w</article>", "w"),
    ("<article></article>", ""), ("<p>a<p>b", "a\n\nb"), ("<table><tr><td>a<td>b</table>", "a\n\nb"),
    ("<article><p>%%% ### $$$</p></article>", "%%% ### $$$"), ("<p hidden>x</p><p>y</p>", "y"),
    ("<article><p>a&ampb &amp</p></article>", "a&b &")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ['<a "', "<!--", "<a '\"", "<", "</div", "<div></span>", "&#x10", "<p>x</a>"])
def test_long_pages_take_linear_time(part):
    started = time.time()
    html_extract.main_text(part * 50_000)
    html_extract.main_text("<div>" * 50_000 + part * 20_000 + "</p>" * 50_000)
    assert time.time() - started < 10


def test_extract(spark):
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, "x", "y"), (2, "v", "<p>é𝄞</p>", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    found = html_extract.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, html_extract.main_text(h), len(html_extract.main_text(h))) for i, u, h, *_ in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert html_extract.extract(pages.limit(0)).collect() == []


# --- conversations ---

def brute_trie(rows, family, modulus):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(role, text) for *_, role, _, text in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % modulus
        built[c] = turns.get(c - (c % family if c >= 0 else -(-c % family)), [])[:h] + own[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        out[min(members[node]), len(node)] = (min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node],
                                              saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(frame):
    rows = frame.collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): tuple(r[2:]) for r in rows}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")


def random_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(-30, -20), 100, 205, 206]:
        kind = rng.random()
        n = rng.randint(1, 9) if kind < 0.7 else 4
        for turn in range(n):
            same = kind > 0.7 or rng.random() < 0.5
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]) if not same else "user",
                         rng.choice(["", None, "a", "b\nc", "é𝄞"]) if not same else f"turn {turn}"))
    rows += [(250, t, "user", f"turn {t}") for t in range(60)]  # a deep chain along the others
    rows += [(300 + i, t, "user", "copy") for i in range(40) for t in range(3)]  # a group of copies
    return rows + [(None, 0, "user", "lost"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, max_rows", [(1, 100_000), (2, 20)])
def test_trie_equals_brute_force(spark, seed, max_rows):
    rows = random_turns(seed)
    rebuilt = conversation_trie.rebuild(conversations(spark, rows).repartition(3), 100, 6, max_rows=max_rows)
    assert trie_rows(conversation_trie.prefix_trie(rebuilt, max_rows)) == brute_trie(rows, 100, 6)


def test_trie_rounds_leave_little_behind(spark, monkeypatch):
    """A round has three joins, two of them in its split, and what finished rounds have left is let go on the way."""
    freed, joins, split = [], [], conversation_trie._split
    monkeypatch.setattr(conversation_trie, "FREE_AFTER", 2)
    monkeypatch.setattr(conversation_trie, "free_shuffles", lambda session: freed.append(session))

    def watched(forest, paths):
        found = split(forest, paths)
        joins.append(found._jdf.queryExecution().optimizedPlan().toString().count("Join ") - forest._jdf.queryExecution()
                     .optimizedPlan().toString().count("Join ") * 2)
        return found

    monkeypatch.setattr(conversation_trie, "_split", watched)
    rows = [(c, t, "user", f"{c % 3}-{t}" if t < 3 else f"{c}-{t}") for c in range(1, 12) for t in range(9)]
    assert trie_rows(conversation_trie.prefix_trie(conversation_trie.rebuild(conversations(spark, rows)))) == brute_trie(rows, 100, 6)
    assert len(joins) > 2 and set(joins) == {2}
    assert len(freed) == (len(joins) + 1) // 2


def test_trie_edges(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rows = [(5, 0, "u", "alone")]  # its first h turns come from an absent conversation
    assert trie_rows(conversation_trie.prefix_trie(conversation_trie.rebuild(conversations(spark, rows)))) == brute_trie(rows, 100, 6)
    assert conversation_trie.prefix_trie(conversation_trie.rebuild(conversations(spark, []))).count() == 0
    rows = [(i, 0, "u", "same") for i in range(25)]
    assert trie_rows(conversation_trie.prefix_trie(conversation_trie.rebuild(conversations(spark, rows)))) == brute_trie(rows, 100, 6)


# --- what earlier operators read back ---

def test_wrong_spans_change_the_loss(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hé<|end|>"), (1, 1, "assistant", "yes 𝄞 [INST]"), (1, 2, "assistant", "more")],
                                  "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    right = chat.chat_digests(formatted).first()
    assert right.loss_sha256 == hashlib.sha256("yes 𝄞 [INST]more".encode()).hexdigest() and right.loss_chars == len("yes 𝄞 [INST]more")
    text, spans = formatted.select("formatted", "spans").first()
    for s in spans:
        raw = text.encode()[s.byte_start:s.byte_start + s.byte_length].decode()
        assert raw == text[s.start:s.start + s.length]
    for name in ("byte_start", "byte_length"):
        moved = formatted.withColumn("spans", F.transform("spans", lambda s: s.withField(name, s[name] - 1)))
        assert chat.chat_digests(moved).first().loss_sha256 != right.loss_sha256


def test_rows_of_one_id_are_dropped_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (8, None), (8, "")], "doc_id long, text string")
    kept = [tuple(r) for r in minhash.keep_first(docs, 5, 80).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (None, a), (8, None), (8, "")], key=str)
