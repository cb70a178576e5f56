"""Chat grammar round trips, URL rules by brute force, and page extraction."""

import hashlib
import random

from ledgerlake.llm import chat_format, html_extract, queries, url_filter


def test_grammar_round_trip():
    rng = random.Random(5)
    parts = ["</s>", "<s>", "[INST]", " [/INST]", "\\", "[", "]", " ", "ok", "<\\s>", "<\\\\/s>", "[\\INST]", "[ASSIST]",
             "[ROLE:x]", "<", "\n", "é", "%5B"]
    for _ in range(8000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "a]b%[", "INST", "%5B"]),
                  "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(3)]
        rendered = "".join(chat_format.render(*t) for t in turns)
        found, stop = chat_format.parse(rendered)
        assert stop == len(rendered) and [t[:2] for t in found] == turns


def test_conversations_with_odd_rows(spark):
    rows = [(1, 2, "assistant", "b</s>", 0), (1, 1, "user", None, 0), (2, 1, None, "x", 0), (2, 1, None, "x", 0),
            (None, None, "assistant", "n", 0)] + [(9, i, "user", "hot", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, hashlib.sha256(b"b</s>").hexdigest())
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, hashlib.sha256(b"").hexdigest())
    assert got[None]["n_turns"] == 1 and got[9]["n_turns"] == 300
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in (
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/"))
        if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_host_rules_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.org", "a.example.org", "my-example.org", "org", "x.com", "COM", "", "forg", "example.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/a", "/de/", "/DE/", "/de/casino/x"]
    urls = [rng.choice(["http://", "x://", "", "://"]) + rng.choice(hosts) + rng.choice(paths)
            + rng.choice(["", "?q=/es/", "#a", "?a://b"]) for _ in range(400)] + [None, "", "://", "http://a\n.org/\n/x"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    judged, col = url_filter.judge(df, queries.URL_RULES)
    for r in judged.collect():
        host, path, rule, verdict = brute(r["url"])
        assert (r[col]["host"], r[col]["path"], r[col]["rule"]) == (host, path, rule), r["url"]
        assert r[col]["verdict"] == (verdict or ("block" if "casino" in path else "allow"))
    assert url_filter.judge(df.limit(0), queries.URL_RULES)[0].count() == 0


def test_the_index_changes_no_verdict():
    rules = list(queries.URL_RULES)
    rng = random.Random(8)
    words = ["casino", "cheap", "pills", "free", "money", "example", "org", "com", "es", "en", "1", "x"]
    for _ in range(3000):
        target = "".join(rng.choice(words) + rng.choice([".", "/", "-", ""]) for _ in range(5))
        counts = {w: rng.randint(0, 9) for w in words}
        assert url_filter.RuleIndex(rules, counts).judge(target) == url_filter.RuleIndex(rules, {}).judge(target)


def test_a_hundred_thousand_rules_from_a_table(spark):
    """Only a URL's own candidates run; verdicts are those of the few rules that can fit."""
    rules = [("block", f"host{i}.example.net/{'a/' * (i % 3)}") for i in range(60_000)]
    rules += [(None, f"scam{i} word{i % 7}") for i in range(40_000)] + [("allow", "example.net/"), ("allow", "HOST5.example.net/x")]
    rules += [("block", ""), ("block", None), rules[0]]
    read = url_filter.rules_from(spark.createDataFrame(rules, "verdict string, rule string"))
    assert len(read) == 100_002
    urls = {"http://host7.example.net/a/b": "block", "http://www.host7.example.net/": "allow", "http://other.example.net/": "allow",
            "http://a.org/SCAM12-Word5/x": "block", "http://a.org/scam12-word6/x": "allow", "http://a.org/scam12": "allow",
            "http://host6.example.net/": "block", "http://host6.example.net.org/": "allow", None: "allow"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    judged, col = url_filter.judge(df, read)
    assert {r["url"]: r[col]["verdict"] for r in judged.collect()} == urls
    index = url_filter.RuleIndex(read, {})
    assert max(len(index.candidates(f"host{i}.example.net/a/a/")) for i in range(0, 60_000, 997)) < 50
    assert len(index.compiled) == 0 and index.judge("host7.example.net/a/b")[1] == "block" and len(index.compiled) < 50


def test_words_match_in_any_case():
    index = url_filter.RuleIndex([url_filter.pattern_rule("Free", "money"), url_filter.host_rule("allow", "example.org/Free/")], {})
    assert index.judge("a.example/FREE--Money/")[1] == "block"
    assert index.judge("a.example/freemoney/")[1] == "allow"
    assert index.judge("example.org/Free/money") == ("example.org/Free/", "allow")
    assert index.judge("example.org/free/money") == (None, "block")


def page(n, paragraphs, extra=""):
    body = "".join(f"<p>{p}" + ("</p>" if n % 2 else "") for p in paragraphs)
    return (f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>'
            f'<nav><ul><li><a href="/">m{n}</a></li></ul></nav><div class="ad">buy {n}</div>'
            f'<div class="wrap"><div class="x"><h1>Title {n}</h1>{body}<div class="legal">Terms apply</div></div>'
            f'{extra}</div><footer>f{n}</footer></body></html>')


def test_template_nodes_are_found_by_alignment(spark):
    rows = [(n, "http://a.example/x", page(n, [f"one  {n} &amp; b", f"two<br>{n} <b>c</b>"])) for n in range(14)]
    rows += [(100, "http://b.example/", page(3, ["alone"])), (101, None, None), (102, "http://c.example/", ""),
             (103, "http://a.example/y", "<p>unclosed <b>x<p>next"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, main_text string")
    read, col = html_extract.extract_pages(df)
    got = {r["page_id"]: r[col] for r in read.collect()}
    assert read.count() == len(rows)
    for n in range(14):
        assert got[n] == f"Title {n}\none {n} & b\ntwo {n} c"      # "Terms apply" is the same on all of them
    assert got[100] == "Title 3\nalone\nTerms apply"               # one page cannot tell
    assert got[101] == got[102] == ""
    assert got[103] == "unclosed x\nnext"
    assert html_extract.extract_pages(df.limit(0))[0].count() == 0


def test_an_odd_first_page_does_not_spoil_its_host(spark):
    """First pages that are empty, an error stub, or without a block that the other pages have."""
    def story(n, notice="<div>Members read more</div>"):
        return (f"<html><body><div>My Site</div><div><a href='/'>Home</a> <a href='/x'>All</a></div>"
                f"<div class='wrap'><h1>Title {n}</h1><p>one {n}</p>{notice}<p>two {n} and more of it</p></div>"
                f"<div>All rights</div></body></html>")
    firsts = {"a": None, "b": "", "c": "<html><body><p>404</p></body></html>", "d": story(0, "")}
    rows = [(n, f"http://{h}.example/{n}", story(n) if n else first) for h, first in firsts.items() for n in range(14)]
    read, col = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r["url"][7], r["page_id"]): r[col] for r in read.collect()}
    assert len(got) == len(rows)
    for h in firsts:
        for n in range(1, 14):
            assert got[h, n] == f"Title {n}\none {n}\ntwo {n} and more of it", (h, n)
    assert [got[h, 0] for h in "abcd"] == ["", "", "404", "Title 0\none 0\ntwo 0 and more of it"]


def test_copies_of_one_page_keep_their_text(spark):
    same = "<html><body><nav>m</nav><article><h1>T</h1><p>all the same</p></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", same) for i in range(60)], "page_id long, url string, html string")
    read, col = html_extract.extract_pages(df)
    assert {r[col] for r in read.collect()} == {"T\nall the same"}


def test_simple_tree_matching_against_brute_force():
    rng = random.Random(2)

    def tree(depth):
        label = rng.choice("ab")
        return label, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []

    def brute_match(x, y):
        if x[0] != y[0]:
            return 0
        best = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, a in enumerate(x[1], 1):
            for j, b in enumerate(y[1], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_match(a, b))
        return 1 + best[-1][-1]

    def shape(t):
        return html_extract._shape(t[0], tuple(shape(k) for k in t[1]))
    for _ in range(400):
        a, b = tree(3), tree(3)
        assert html_extract.weight(shape(a), shape(b)) == brute_match(a, b)


def test_long_lists_are_aligned_like_short_ones():
    """Row-wise alignment gives the pairs of the plain one, ties included."""
    rng = random.Random(6)
    leaves = [html_extract._shape(c, ()) for c in "abc"]
    trees = leaves + [html_extract._shape("d", tuple(rng.choices(leaves, k=rng.randint(0, 4)))) for _ in range(12)]
    for _ in range(300):
        a, b = (rng.choices(trees, k=rng.randint(1, 40)) for _ in "ab")
        assert html_extract._many(a, b) == html_extract._few(a, b)


def test_deep_pages_are_read(spark):
    def deep(n, depth=5000):
        return f"<html><body>{'<div>' * depth}<p>deep {n}</p>{'<span>x' * (n % 3)}{'</div>' * (depth if n % 2 else 0)}</body></html>"
    assert html_extract.extract(deep(0)) == "deep 0"
    df = spark.createDataFrame([(n, "http://d.example/", deep(n, 1500)) for n in range(14)], "page_id long, url string, html string")
    read, col = html_extract.extract_pages(df)
    assert all(r[col].startswith(f"deep {r['page_id']}") for r in read.collect())
    shapes = []
    for leaf in "ab":
        shape = html_extract._shape(leaf, ())
        for _ in range(3000):
            shape = html_extract._shape("div", (shape,))
        shapes.append(shape)
    assert html_extract.weight(*shapes) == 3000


def test_quotes_belong_to_tags_only_after_an_equals_sign():
    cases = {
        "<p title=it's>First words here.</p><p>Second don't par.</p><p>Third par.</p>": "First words here.\nSecond don't par.\nThird par.",
        '<p class="a"">First</p><p>Second "quoted" words</p>': 'First\nSecond "quoted" words',
        '<p>x <img alt="5" screen"> y</p><p>z</p>': "x y\nz",
        "<p data-a='1 > 0' class = \"b > c\">in</p>": "in",
        '<p a=b="c>d</p><p>e</p>': "d\ne",
        "<p\n id=x\n>new\nline</p>": "new line",
        '<p title="never closed>lost</p>': "lost",
    }
    for source, want in cases.items():
        assert html_extract.extract(source) == want, source
    node = html_extract.parse("<div data-class='x' CLASS='Big Box' id=main></div>").children[0]
    assert node.label == "div.big box"


def test_a_constant_block_between_thousands_of_children_is_found(spark):
    """Blocks of all pages far apart in very long lists."""
    def page(n, many=3000):
        kinds = ["ul" if (i + n * (n % 2)) % 3 else "ol" for i in range(many if n % 2 else 100)]
        own = "".join(f"<p>{n} item {i}</p><{k}></{k}>" for i, k in enumerate(kinds))
        cut = own.index("<p>", len(own) // 2)
        return f"<html><body><div class='wrap'>{own[:cut]}<div class='x'>Terms apply</div>{own[cut:]}</div></body></html>"
    df = spark.createDataFrame([(n, "http://l.example/", page(n)) for n in range(12)], "page_id long, url string, html string")
    read, col = html_extract.extract_pages(df)
    got = {r["page_id"]: r[col] for r in read.collect()}
    assert all("Terms apply" not in t and t.count("\n") == (2999 if n % 2 else 99) for n, t in got.items())


def test_slugs_inside_articles_stay():
    source = ("<body><div id='sidebar'>side</div><article><h2 id='social-impact'>Social impact</h2><section id='related-work'><p>Before us</p>"
              "</section><p id='share-prices'>Shares fell</p><h3 class='share'>Sharing data</h3><div class='comment-list'>no</div>"
              "<div class='social-science'>yes</div><div id='comments'>no</div></article><div class='promo-teaser'>no</div></body>")
    assert html_extract.extract(source) == "Social impact\nBefore us\nShares fell\nSharing data\nyes"


def test_several_articles_are_all_read():
    two = "<body><nav>m</nav><main><article><p>one long text</p></article><article><p>two long text</p></article></main></body>"
    assert html_extract.extract(two) == "one long text\ntwo long text"
    plain = two.replace("main>", "div>")
    assert html_extract.extract(plain) == "one long text\ntwo long text"
    with_comments = "<body><article><p>the text</p></article><article class='comment'><p>a reader's long remark</p></article></body>"
    assert html_extract.extract(with_comments) == "the text"
