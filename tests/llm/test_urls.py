import random

from lodestone.llm.urls import PERIOD, filtered, intervals


def brute(captures, entries):
    events = {}
    for kind, domain, listed, at in entries:
        if None not in (kind, domain, listed, at):
            key = (kind, domain.lower())
            times = events.setdefault(key, {})
            times[at] = times.get(at, True) and listed
    out = []
    for i, url, at in captures:
        host = None
        if url and "://" in url:
            host = url.split("://")[1].split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower() or None
        best = None
        if host and at is not None:
            labels = host.split(".")
            for k in range(max(1, len(labels) - 1)):
                name = ".".join(labels[k:])
                for kind in ("allow", "block"):
                    before = [t for t in events.get((kind, name), {}) if t <= at]
                    if before and events[kind, name][max(before)]:
                        best = max(best or (), (len(name), kind == "allow", kind, name))
        out.append((i, host, best[3] if best else None, best[2] if best else None, not (best and best[2] == "block")))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.z.org", "org", "localhost", "Z.ORG"]
    captures = [(i, f"http://u@{rng.choice(hosts)}:80/p?q=http://no.com", rng.randrange(0, 10 * PERIOD)) for i in range(300)]
    captures += [(300, None, 5), (301, "no url", 5), (302, "http://example.com", None), (303, "", 7), (304, "http:///x", 7), captures[0], captures[0]]
    entries = [(rng.choice(["block", "allow"]), rng.choice([h.lower() for h in hosts] + ["z.org", "com"]), rng.random() < 0.6, rng.randrange(0, 10 * PERIOD)) for _ in range(120)]
    entries += [("block", "Example.com", True, 100), ("block", "example.com", False, 100), (None, "example.com", True, 1), ("block", None, True, 1), entries[0]]
    frame = spark.createDataFrame([(*c, "k") for c in captures], "page_id long, url string, fetched long, list string")
    listed = spark.createDataFrame(entries, "list string, domain string, listed boolean, at long")
    got = [(r.page_id, r.host, r.listed_domain, r.list, r.kept) for r in filtered(frame, listed).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(brute(captures, entries), key=key)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "page_id long, url string, fetched long")
    listed = spark.createDataFrame([], "list string, domain string, listed boolean, at long")
    assert filtered(frame, listed).count() == 0 and intervals(listed).count() == 0
    some = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, fetched long")
    assert [r.kept for r in filtered(some, listed).collect()] == [True]
