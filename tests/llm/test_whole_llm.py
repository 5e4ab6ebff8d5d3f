"""Operators of the subpackage that once stopped short, against solved or brute-force results."""

from __future__ import annotations

import json
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pytest

from ordina.llm import link_rank


def solved(seed: list[float], links: list[tuple[int, int]], damping: float) -> np.ndarray:
    """x = seed + damping * what links bring, each host's links in equal shares."""
    n = len(seed)
    m = np.zeros((n, n))
    for a, b in links:
        m[b, a] += 1
    m /= np.maximum(1, m.sum(axis=0))
    return np.linalg.solve(np.eye(n) - damping * m, np.array(seed))


def test_long_chain_and_cycle(spark):
    """Hosts c0 -> ... -> c11 (blocked pages) and a cycle r0 -> ... -> r4 -> r0 with an allowed page."""
    chain, ring = [f"c{k}.io" for k in range(12)], [f"r{k}.io" for k in range(5)]
    hosts = [*chain, *ring]
    links = [(k, k + 1) for k in range(11)] + [(12 + k, 12 + (k + 1) % 5) for k in range(5)]
    to = dict(links)
    pages = [{"host": h, "html": f'<a href="https://{hosts[to[k]]}/">' if k in to else "", "ruled_verdict": None} for k, h in enumerate(hosts)]
    pages += [{"host": "c11.io", "html": "", "ruled_verdict": "block"}] * 1000 + [{"host": "c0.io", "html": "", "ruled_verdict": None}] * 9 + [{"host": "r0.io", "html": "", "ruled_verdict": "allow"}, {"host": "r2.io", "html": "", "ruled_verdict": "block"}]
    df = spark.createDataFrame(pd.DataFrame(pages), "host string, html string, ruled_verdict string")
    got = {r.host: r for r in link_rank.host_scores(df).collect()}
    seeds = {v: [float(sum(p["host"] == h and p["ruled_verdict"] == v for p in pages)) for h in hosts] for v in ("allow", "block")}
    trust, distrust = solved(seeds["allow"], links, 0.85), solved(seeds["block"], [(b, a) for a, b in links], 0.85)
    assert np.allclose([got[h].trust for h in hosts], trust, atol=1e-5) and np.allclose([got[h].distrust for h in hosts], distrust, atol=1e-5)
    assert got["c0.io"].host_blocked and got["c0.io"].pages == 10


HTML = [
    '<p><a href="https://B.com/x">b</a> <A HREF=\'http://c.com:8080/\'>c</A></p>',
    "<a class=x href=http://d.com/a>d</a><img src=//e.com/i.png>",
    '<a href=" https://b.com/ ">b</a><a\nhref = "https://u:p@f.com:1/q?x#y">f</a>',
    '<a data-href="https://no.com/" href="/own">x</a><a href="#top">y</a><a href="mailto:x@z.com">z</a>',
    '<a title="t"href="https://g.com">g</a><a href="">e</a><a href>e</a>',
    None,
    "",
    "plain text, href but no tag",
]


def test_links_against_a_parser(spark):
    """Hosts of links, against Python's own HTML parser and URL splitter."""
    want = Counter()

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            for name, value in attrs:
                if name in ("href", "src") and value and (host := urlsplit(value.strip()).netloc.rpartition("@")[2].lower()):
                    want["a.com", host] += 1

    for html in HTML:
        Links().feed(html or "")
    got = link_rank.edges(spark.createDataFrame([("a.com", h) for h in HTML], "host string, html string")).collect()
    assert {(r.src, r.dst): r.links for r in got} == want and len(want) == 6


def test_hub_in_parts(spark, monkeypatch):
    """A hub whose links are split over tasks gives what the solved system gives."""
    hosts = ["hub.io", *[f"h{k}.io" for k in range(12)]]
    links = [(0, k) for k in range(1, 13)] + [(k, 0) for k in range(1, 13)] + [(1, 2)]
    html = {k: "".join(f'<a href="https://{hosts[b]}/">' for a, b in links if a == k) for k in range(13)}
    pages = [(h, html[k], "allow" if k == 0 else "block" if k in (3, 4) else None) for k, h in enumerate(hosts)]
    df = spark.createDataFrame(pages, "host string, html string, ruled_verdict string")
    monkeypatch.setattr(link_rank, "HUB", 3)
    got = {r.host: r for r in link_rank.host_scores(df, link_rank.Spread(tolerance=1e-3, cut=8)).collect()}
    trust = solved([1.0, *[0.0] * 12], links, 0.85)
    distrust = solved([float(k in (3, 4)) for k in range(13)], [(b, a) for a, b in links], 0.85)
    assert np.allclose([got[h].trust for h in hosts], trust, atol=2e-3) and np.allclose([got[h].distrust for h in hosts], distrust, atol=2e-3)


def test_byte_cnn_learns_from_long_texts(spark):
    """Texts beyond most_chars are learned from like others, by a span of each; none is left out."""
    from ordina.llm import byte_cnn

    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 300)) for _ in range(60)]
    bad = [" ".join(rng.choice(["###", "$$$", "||", "%&"], 600)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    net = byte_cnn.train(docs, labels, byte_cnn.Training(most_chars=100, epochs=6, short=0.0))
    assert net is not None
    rows = byte_cnn.classify(docs, net, 0.5).collect()
    assert len(rows) == 120 and sum(r.predicted == int(r.doc_id < 60) for r in rows) >= 118


def test_other_tokenizers_are_refused(tmp_path):
    """A file that cuts words otherwise raises; the given one doesn't."""
    from ordina.llm import _word_ids

    spec = _word_ids._read(_word_ids.default_tokenizer())
    other = tmp_path / "other.json"
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": spec["model"] | {"end_of_word_suffix": None}}):
        other.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="not a tokenizer"):
            _word_ids._read(str(other))
