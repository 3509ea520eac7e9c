"""Source resolution and path groups against literal loops on hand-made and random trees."""

from __future__ import annotations

import random
import re

import pytest

from fleetlens.operators import sources

SPEC = "origin string, base string, pattern string, exclude array<string>, source string"


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("a*", ["a", "ab", "a.b"], ["b", "ba"]), ("?", ["a", "é"], ["", "ab"]), ("[a-c]x", ["ax", "cx"], ["dx", "-x"]), ("[^a-c]", ["d", "]"], ["a", "b"]), ("[a\\]]", ["a", "]"], ["b"]), ("\\*", ["*"], ["a"]),
        ("a.b", ["a.b"], ["axb"]), ("[]a]", [], ["]", "a"]), ("[a", [], ["a", "[a"]), ("[-a]", [], ["-", "a"]), ("x[c-a]", [], ["xb"]), ("a\\", [], ["a"]), ("web-[[]1]", ["web-[1]"], ["web-1"]), ("$^{}", ["$^{}"], ["$"]),
    ],
)
def test_segments(pattern, yes, no):
    rule = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), sources.segment_regex(pattern)))
    assert all(rule.search(x) for x in yes) and not any(rule.search(x) for x in no)


def resolved(spark, specs, dirs):
    rows = [(o, b, p, x, "clash") for o, b, p, x in specs]
    got = sources.resolve_sources(spark.createDataFrame(rows, SPEC), spark.createDataFrame([(d, 1) for d in dirs], "path string, rel int"))
    return sorted((r.origin, r.base, r.source, r.kind, list(r.exclude)) for r in got.collect())


def test_resolve_sources(spark):
    dirs = ["/srv/web-[a]/logs", "/srv/web-b", "/srv/data", "/home/u1/mail/new", "/home/u2/mail", "/home/u2/docs", "/data/projects/alpha/src", "/data/projects/beta", "/data/qa"]
    x = ["*.tmp", "./web-[a]/logs", "./web-b", "./web-b/x", "./other/y", "./web", "./web-[a]"]
    got = resolved(spark, [("plain", None, "/srv/data", ["./a"]), ("whole", "/srv", "", ["./a"]), ("part", "/srv", "web-*", x[:6]), ("gone", "/srv/", "web-[[]a[]]", x[6:])], dirs)
    by = {(r[0], r[2]): r for r in got}
    assert by["part", "/srv/web-[a]"][3:] == ("child", ["*.tmp", "./logs"]) and ("part", "/srv/web-b") not in by
    assert by["part", "/srv"][3:] == ("rest", ["*.tmp", "./other/y", "./web", "./web-\\[a\\]", "./web-b"])
    assert by["plain", "/srv/data"][3:] == ("plain", ["./a"]) and by["whole", "/srv"][3:] == ("plain", ["./a"])
    assert by["gone", "/srv/"][3:] == ("rest", ["./web-[a]"])  # "[]]" is malformed, so nothing is carved
    got = resolved(spark, [("sel", None, "/home/*/mail", ["./a"]), ("top", "", "/[d-h]*", None), ("none", None, "/nowhere/*", []), ("lit", "/data", "projects", ["./projects/alpha/src"]), ("deep", "/data", "projects/*", None), ("lost", "/data", "x", None)], dirs)
    assert [r[:4] for r in got] == [
        ("deep", "/data", "/data", "rest"), ("deep", "/data", "/data/projects/alpha", "child"), ("deep", "/data", "/data/projects/beta", "child"), ("lit", "/data", "/data", "rest"), ("lit", "/data", "/data/projects", "child"),
        ("lost", "/data", "/data", "rest"), ("sel", "/home", "/home/u1/mail", "child"), ("sel", "/home", "/home/u2/mail", "child"), ("top", "/", "/data", "child"), ("top", "/", "/home", "child"),
    ]
    by = {(r[0], r[2]): r[4] for r in got}
    assert by["sel", "/home/u1/mail"] == ["./a"] and by["lit", "/data/projects"] == ["./alpha/src"] and by["lit", "/data"] == ["./projects"] and by["lost", "/data"] == []
    assert resolved(spark, [], dirs) == [] and resolved(spark, [("o", "/b", "*", None)], []) == [("o", "/b", "/b", "rest", [])]


def glob_match(pattern, name):
    rule = sources.segment_regex(pattern)
    return bool(re.search(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), rule), name))


def slow_resolve(specs, dirs):
    every = {"/" + "/".join(d.strip("/").split("/")[: i + 1]) for d in dirs for i in range(d.strip("/").count("/") + 1)}
    out = []
    for origin, base, pattern, exclude in specs:
        root = base
        if not base:
            segs = pattern.split("/")
            k = next((i for i, s in enumerate(segs) if any(c in s for c in "*?[")), len(segs))
            if k == len(segs):
                out.append((origin, None, pattern, "plain", exclude))
                continue
            root, pattern = "/".join(segs[:k]) or "/", "/".join(segs[k:])
        elif not pattern:
            out.append((origin, None, base, "plain", exclude))
            continue
        stem = root.rstrip("/") + "/"
        found = sorted(d for d in every if d.startswith(stem) and d[len(stem) :].count("/") == pattern.count("/") and all(glob_match(p, n) for p, n in zip(pattern.split("/"), d[len(stem) :].split("/"), strict=True)))
        anchored = [x for x in exclude if base and x.startswith("./")]
        general = [x for x in exclude if x not in anchored]
        names = [d[len(stem) :] for d in found]
        for d, name in zip(found, names, strict=True):
            if "./" + name not in anchored:
                out.append((origin, root, d, "child", general + ["./" + x[len(name) + 3 :] for x in anchored if x.startswith(f"./{name}/")]))
        if base:
            free = [x for x in anchored if not any(x == "./" + n or x.startswith(f"./{n}/") for n in names)]
            out.append((origin, root, root, "rest", general + free + ["./" + re.sub(r"([\\*?\[\]])", r"\\\1", n) for n in names]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_sources_like_a_loop(spark, seed):
    rng = random.Random(seed)
    names = ["a", "ab", "b", "b*", "c[x]", "a-b", "é"]
    pick = lambda k: "/".join(rng.choice(names) for _ in range(k))
    dirs = ["/" + pick(rng.randint(1, 4)) for _ in range(60)]
    globs = ["*", "a*", "?", "[ab]", "[^a]*", "b", "c\\[x\\]", "*b"]
    specs = []
    for i in range(40):
        pattern = "/".join(rng.choice(globs) for _ in range(rng.randint(1, 3)))
        exclude = [rng.choice(["*.o", "./" + pick(rng.randint(1, 3)), "./" + pick(1) + "/"]) for _ in range(rng.randint(0, 4))]
        exclude = list(dict.fromkeys(exclude))
        specs.append((f"o{i}", rng.choice(["/" + pick(1), "/", "/" + pick(2)]), pattern, exclude) if rng.random() < 0.7 else (f"o{i}", "", "/" + rng.choice(["", pick(1) + "/"]) + pattern, exclude))
    assert sorted(resolved(spark, specs, dirs), key=str) == slow_resolve(specs, dirs)


def common_dir(a, b):
    while not (b == a or b.startswith(a + "/")):
        a = a[: a.rfind("/")] if a.rfind("/") > 0 else "/"
        if a == "/":
            break
    return a


def slow_groups(items):
    """Groups of (host, path): a recursion over runs of neighbours in path order."""
    out = {}
    clean = lambda p: p.rstrip("/") or "/"

    def arrange(own):
        d = clean(own[0][1])
        for m in own[1:]:
            d = common_dir(d, clean(m[1]))
        if len(own) == 1:
            out[own[0]] = (d, None, False)
            return
        parts = {}
        for m in own:
            parts.setdefault(clean(m[1])[len(d) + 1 :].split("/")[0], []).append(m)
        rooted = "" in parts
        big = [s for s, p in parts.items() if len(p) >= 2]
        covered = any(clean(parts[s][0][1]) == f"{d}/{s}" for s in big)
        noise = sum(clean(m[1])[len(d) + 1 :].count("/") for m in own)
        if rooted or not covered and (not big or noise <= 8):
            for m in own:
                out[m] = (d, clean(m[1])[len(d) + 1 :], rooted)
            return
        for s in parts:
            arrange(parts[s])

    rest = []
    for m in items:
        if m[0]:
            rest.append(m)
        else:
            out[m] = (m[1], None, False)
    rest.sort(key=lambda m: (m[0], clean(m[1])))
    i = 0
    while i < len(rest):
        j = i + 1
        while j < len(rest) and rest[j][0] == rest[i][0] and common_dir(clean(rest[i][1]), clean(rest[j][1])) != "/":
            j += 1
        arrange(rest[i:j])
        i = j
    return out


@pytest.mark.parametrize("seed", range(4))
def test_path_groups_like_a_recursion(spark, seed):
    rng = random.Random(seed)
    names = ["data", "data-x", "data+", "a", "b", "mnt", "long-name", "é"]
    items = {("h0", "/"), (None, "bare"), ("", "/data/x"), ("h9", "/only/one")}
    for _ in range(150):
        depth = rng.choice([1, 2, 2, 3, 3, 4, 6])
        items.add((f"h{rng.randrange(5)}", "/" + "/".join(rng.choice(names[: rng.choice([2, 8])]) for _ in range(depth)) + rng.choice(["", "", "/"])))
    items |= {(f"h{h}", f"/mnt/{a}/{b}") for h in (5, 6) for a in ("photo", "docs") for b in range(2 if h == 5 else 9)}
    items |= {("h7", "/tank/customers/acme"), ("h7", "/tank/customers/globex"), ("h7", "/tank/internal/wiki"), ("h7", "/tank/internal/crm")}
    got = {(r.host, r.path): (r.base, r.label, r.rooted) for r in sources.path_groups(spark.createDataFrame([(h, p, "x") for h, p in sorted(items, key=str)], "host string, path string, base string")).collect()}
    assert got == slow_groups(sorted(items, key=str))
    assert got["h7", "/tank/internal/crm"] == ("/tank", "internal/crm", False) and got["h6", "/mnt/photo/3"] == ("/mnt/photo", "3", False)


def test_path_groups_of_nothing(spark):
    none = spark.createDataFrame([], "host string, path string")
    assert sources.path_groups(none).count() == 0
    twice = spark.createDataFrame([("h", "/a"), ("h", "/a/"), ("h", None)], "host string, path string")
    assert sorted((r.path, r.base, r.label, r.rooted) for r in sources.path_groups(twice).filter("path is not null").collect()) == [("/a", "/a", "", True), ("/a/", "/a", "", True)]
