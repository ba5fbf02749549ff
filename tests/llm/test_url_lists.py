import random

from cairn.llm import url_lists as u


def keys_of(url):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    host = m[1].lower() if m else ""
    labels = host.split(".")
    out = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))]
    seg = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", url or "")
    return [k for k in out + ([f"{host}/{seg[1]}"] if seg else []) if k]


def brute(captures, entries):
    order = {"block": 0, "allow": 1, "remove": 2}
    lists = {}
    for key, at, action in entries:
        if None not in (key, at, action):
            held = lists.setdefault(key, {})
            if at not in held or order[action] < order[held[at]]:
                held[at] = action
    out = []
    for page, url, t in captures:
        best = None
        for key in keys_of(url):
            past = [a for a in lists.get(key, {}) if t is not None and a <= t]
            if past and lists[key][max(past)] != "remove":
                best = max(best or (0, "", 0, ""), (len(key), key, max(past), lists[key][max(past)]))
        out.append((page, best is not None and best[3] == "block", best and best[1], best and best[2]))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(u, "ROWS_IN_RANGE", 40)  # many ranges
    rnd = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.org", "localhost"]
    captures = [(i, f"http://{rnd.choice(hosts[: 1 if i % 3 == 0 else 4])}/{rnd.choice(['x', 'y', ''])}/p?q", rnd.randrange(2000)) for i in range(400)]
    captures += [(500, None, 5), (501, "nonsense", 5), (502, "HTTP://user@A.Example.com:80/x", None), (503, "ftp://A.EXAMPLE.COM/x", 1999), captures[0]]
    names = ["a.example.com", "example.com", "a.example.com/x", "localhost", "example.org", None]
    entries = [(rnd.choice(names), rnd.choice([rnd.randrange(2000), None if i % 9 == 0 else 7]), rnd.choice(["block", "allow", "remove"])) for i in range(300)]
    c = spark.createDataFrame([(*x, "clash") for x in captures], "page_id long, url string, fetched long, rule string")
    e = spark.createDataFrame(entries, "key string, dated long, action string")
    got = sorted((r.page_id, r.blocked, r.rule, r.since) for r in u.judged(c, e).collect())
    assert got == sorted(brute(captures, entries))


def test_empty_tables(spark):
    c = spark.createDataFrame([(1, "http://a.b/", 3)], "page_id long, url string, fetched long")
    e = spark.createDataFrame([], "key string, dated long, action string")
    assert [tuple(r) for r in u.judged(c, e).collect()] == [(1, "http://a.b/", 3, False, None, None)]
    assert u.judged(c.limit(0), e).count() == 0
