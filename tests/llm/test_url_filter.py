"""Rules against brute force, and verdicts of the template tree on held-out labels."""

import re

from breathline.llm.op4 import RULES
from breathline.llm.url_filter import judge


def brute(url):
    """host, path, rule and its verdict by the contract."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(r, v) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?q", "https://www.example.com/en/", "http://example.com/en", "http://x.net/es/1#a", "http://net/fr/", "http://anet/fr/", "ftp://h.org/a/b?c", "http://x.com", "a://b://c.net/es/"]
    rows = [(i % 7 or None, u, "h", 1) for i, u in enumerate(urls + urls[:4])]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, n int")
    got = judge(frame, RULES).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(u))) for i, u, _, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), str(r.verdict if r.rule else None)) for r in got) == want
    assert judge(frame.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge(frame, []).collect()} == {"allow"}


def test_templates_carry_labels_to_unseen_urls(spark):
    """Branches of a host with labels of one kind judge their other urls; branches without labels don't."""
    rules = [("block", f"h{h}.net/bad/{i}/") for h in range(3) for i in range(30)] + [("allow", f"h{h}.net/good/{i}/") for h in range(3) for i in range(30)]
    urls = [f"http://h{h}.net/{kind}/{i}/page{i * j}" for h in range(3) for kind in ("bad", "good") for i in range(40) for j in range(3)]
    urls += [f"http://h{h}.net/other/{i}" for h in range(3) for i in range(5)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge(frame, rules).collect()
    held = {kind: [r.verdict for r in got if r.rule is None and f"/{kind}/" in r.path] for kind in ("bad", "good", "other")}
    assert len(held["bad"]) == 90 and set(held["bad"]) == {"block"}
    assert set(held["good"]) == set(held["other"]) == {"allow"}
