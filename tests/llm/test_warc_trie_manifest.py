"""Archive conversion, prefix trie and Merkle manifest: brute force, round trips, and odd inputs."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import arc_to_warc, merkle_manifest, prefix_trie
from plumbline.session import new_path

# --- 11 --------------------------------------------------------------------------------------------

V1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 71\n1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2_BODY = b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = b"filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc %d\n%s\n" % (len(V2_BODY), V2_BODY)
HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff\x00 one\n\n"


def arc1(url, body, kind=b"text/html", date=b"19961231235959"):
    return b"%s 1.2.3.4 %s %s %d\n%s\n" % (url, date, kind, len(body), body)


def arc2(url, body):
    return b"%s 1.2.3.4 19961231235959 text/html 200 abc - 77 b.arc %d\n%s\n" % (url, len(body), body)


def test_arc_header_lines_of_both_versions():
    first = V1.replace(b" 71\n", b" %d\n" % len(V1.split(b"\n", 1)[1][:-1]))
    one = list(arc_to_warc.arc_records(memoryview(first + arc1(b"http://x/a b?c d", HTTP) + arc1(b"dns:x", b"19961231 x 1.2.3.4", b"text/dns"))))
    assert [(r["version"], r["url"], r["type"], r["body"]) for r in one[1:]] == [(1, "http://x/a b?c d", "text/html", HTTP), (1, "dns:x", "text/dns", b"19961231 x 1.2.3.4")]
    two = list(arc_to_warc.arc_records(memoryview(V2 + arc2(b"http://y/", HTTP) + b"\n\r\n" + arc2(b"http://z/", b""))))
    assert [(r["version"], r["url"], r.get("code"), r["body"]) for r in two[1:]] == [(2, "http://y/", "200", HTTP), (2, "http://z/", "200", b"")]
    assert (V2 + arc2(b"http://y/", HTTP))[two[1]["at"] :].startswith(b"http://y/")
    cut = list(arc_to_warc.arc_records(memoryview((V2 + arc2(b"http://y/", HTTP))[:-9])))
    assert cut[1]["truncated"] and not cut[0]["truncated"]
    with pytest.raises(ValueError, match="at byte"):
        list(arc_to_warc.arc_records(memoryview(V2 + b"no header at all\n")))


def test_arc_archives_of_many_gzip_members():
    big = b"HTTP/1.0 200 OK\r\n\r\n" + random.Random(1).randbytes(5_000_000)
    parts = [V2, arc2(b"http://a/", HTTP), arc2(b"http://b/", big), arc2(b"http://c/", HTTP)]
    plain = [r["body"] for r in arc_to_warc.arc_records(memoryview(b"".join(parts)))]
    for packed in (b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)) + b"\0" * 64):
        assert [r["body"] for r in arc_to_warc.arc_records(memoryview(packed))] == plain
    assert list(arc_to_warc.arc_records(memoryview(b""))) == []


def test_warc_equivalents_of_arc_records():
    records = list(arc_to_warc.arc_records(memoryview(V2 + arc2(b"http://y/", HTTP) + arc2(b"ftp://y/", b"no http"))))
    fields, head, payload = zip(*(arc_to_warc.warc_equivalent(r, "b.arc") for r in records))
    assert [f["WARC-Type"] for f in fields] == ["warcinfo", "response", "resource"]
    assert fields[1]["WARC-Date"] == "1996-12-31T23:59:59Z" and head[1] + payload[1] == HTTP
    assert fields[1]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload[1]).digest()).decode()
    assert len({f["WARC-Record-ID"] for f in fields}) == 3 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) for f in fields)
    whole = b"".join(arc_to_warc.warc_bytes(f, h + p) for f, h, p in zip(fields, head, payload))
    back = list(arc_to_warc.warc_records(memoryview(whole)))
    assert [b for _, _, b in back] == [h + p for h, p in zip(head, payload)]
    assert [arc_to_warc.iso_time(d) for d in ("1996", "19961231", "199612312359", "19961231235959123")] == ["1996-01-01T00:00:00Z", "1996-12-31T00:00:00Z", "1996-12-31T23:59:00Z", "1996-12-31T23:59:59.123Z"]


def converted(spark, pages, min_bytes=0):
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    arc_to_warc.write_arc(pages, arcs)
    arc_to_warc.convert(spark, arcs, warcs, min_bytes)
    return arc_to_warc.resolved(arc_to_warc.captures(arc_to_warc.archives(spark, warcs))).collect()


def test_pages_to_arc_to_warc_and_back(spark):
    rng = random.Random(11)
    texts = ["same for a third", *(f"<p>{k} ünï\r\n\r\n" + "x" * rng.randint(0, 3000) for k in range(40)), "", None]
    rows = [(i, f"http://h/{i} {i}", texts[0] if i % 3 == 0 else rng.choice(texts)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in converted(spark, pages)}
    assert len(got) == 300 and all(r.intact for r in got.values())
    last = {}
    for i, _, t in rows:
        last[t or ""] = i
    for i, url, t in rows:
        t = t or ""
        data, r = t.encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[t] == i else ("revisit", last[t]))
        assert r.uri == url.replace(" ", "%20")
    few = {r.page_id: r.record_type for r in converted(spark, pages, min_bytes=10)}
    assert {few[i] for i, _, t in rows if not t} == {"response"} and few[0] == "revisit"


def test_archives_of_odd_pages(spark):
    rows = [(None, None, None), (None, "u", ""), (1, "", "a\0b"), (1, "", "a\0b"), (2, "a\nb\rc", "x" * 3_000_000), (3, "é", "a\0b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"at": F.lit(1), "content": F.lit("c"), "body": F.lit(2), "record": F.lit(3), "value": F.lit(4), "path": F.lit("p")})
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes, r.uri, r.intact) for r in converted(spark, pages))
    assert [g[:4] for g in got if g[0]] == [(1, "revisit", 3, 3), (1, "revisit", 3, 3), (2, "response", 0, 3_000_000), (3, "response", 0, 3)]
    assert sorted(g[1] for g in got if not g[0]) == ["response", "revisit"] and all(g[5] for g in got)
    assert {g[4] for g in got} == {"about:blank", "u", "a%0Ab%0Dc", "é"}
    assert converted(spark, pages.limit(0)) == []


# --- 12 --------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """The contract, row by row."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    out = {}
    for p, who in members.items():
        ids = sorted(c for c, ends in who if ends)
        out[p] = {"conv_id": min(c for c, _ in who), "depth": len(p), "n_convs": len(who), "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}
    for p in sorted(out, key=len, reverse=True):
        out[p]["n_leaves"] += out[p]["n_children"] == 0
        out[p]["saved_tokens"] += (out[p]["n_convs"] - 1) * words[p]
        out[p]["parent_conv_id"] = out[p[:-1]]["conv_id"] if p else None
        if p:
            out[p[:-1]]["n_children"] += 1
            out[p[:-1]]["n_leaves"] += out[p]["n_leaves"]
            out[p[:-1]]["saved_tokens"] += out[p]["saved_tokens"]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(x[c] if x[c] is not None else -10**9 for c in columns) for x in out.values())


def trie_rows(spark, rows, shard_turns, group=prefix_trie.GROUP):
    conversations = spark.createDataFrame(rows, CONV).withColumns({"key": F.lit(1), "path": F.lit("p"), "words": F.lit(2), "n": F.lit(3), "shard": F.lit(4)})
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_sequences(conversations)), shard_turns, group).collect()
    return sorted(tuple(x if x is not None else -10**9 for x in r) for r in out)


@pytest.mark.parametrize("shard_turns", [7, 60, 10**6])
def test_trie_against_brute_force(spark, shard_turns):
    rng = random.Random(12)
    rows = []
    for c in range(-30, 170):
        for t in range(rng.randint(1, 6)):
            # a third share all turns, most share the first, few values, so that prefixes branch
            text = "same words here" if c % 3 == 0 or (t == 0 and rng.random() < 0.7) else rng.choice(["a", "b c", "", None, "d  e\tf"])
            rows.append((c, t, rng.choice(["user", "assistant"]) if c % 3 else "user", text))
    rows += [(900, t, "user", f"turn {t % 50}") for t in range(70)] + [(901, t, "user", f"turn {t % 50}") for t in range(55)] + [(902, t, "user", f"turn {t % 50}") for t in range(32)]
    rng.shuffle(rows)
    assert trie_rows(spark, rows, shard_turns) == brute_trie(rows)


def test_trie_in_many_rounds_of_shards(spark):
    rng = random.Random(13)
    rows = [(1000 + 20 * c + 1, t, "u", rng.choice("ab")) for c in range(300) for t in range(rng.randint(0, 12))]
    assert trie_rows(spark, rows, 40, 3) == brute_trie(rows)


def test_trie_of_odd_conversations(spark):
    rows = [(None, 1, "u", "lost"), (0, None, None, None), (0, 1, "u", "x"), (0, 1, "u", "x"), (0, 1, "a", "x"), (5, 3, "u", "y" * 200_000), (7, 0, "u", "only")]
    rows += [(20 + k, 0, "u", "one turn, which the missing first conversation takes away") for k in range(1, 8)]
    assert trie_rows(spark, rows, 3) == brute_trie(rows)
    assert trie_rows(spark, rows[:1], 3) == []


def test_ending_members_over_packs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 10)
    ids = random.Random(3).sample(range(10**6), 500)
    members = spark.createDataFrame([(bytearray(b"k"), i) for i in ids] + [(bytearray(b"l"), 5)], "key binary, conv_id long").repartition(4)
    got = {bytes(r.key): (r.n, r.conv_id, r.ends_sha256) for r in prefix_trie.ending_members(members).collect()}
    assert got[b"k"] == (500, min(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())
    assert got[b"l"] == (1, 5, hashlib.sha256(b"5").hexdigest())


# --- 13 --------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, t: H(*map(field, (r[0], r[3], r[2], r[4], t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][a : a + 16]) for a in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            run = level[i - i % 16 : i - i % 16 + 16]
            out.append((run[: i % 16], run[i % 16 + 1 :]))
            i //= 16
        return out

    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r, lower(r[1])) if tampered else own
            for before, after in steps:
                h = H(*before, h, *after)
            out.append((-1 if r[0] is None else r[0], own, trees[s][-1][0], top[-1][0], H(*(x for b, a in steps for x in b + a)), h, h == top[-1][0]))
    return sorted(out)


def proved_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "place": F.lit(2), "digest": F.lit(3), "id": F.lit(4), "other": F.lit(5), "pos": F.lit(6)})
    return sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in merkle_manifest.proved(docs).collect())


@pytest.mark.parametrize("height", range(5))
def test_van_emde_boas_addresses_are_a_packed_order(height):
    for n in {1, 2, 15, 16, 17, 255, 256, 257, 1000, 4096} & set(range(1, 16**height + 1)):
        at = merkle_manifest.addresses(n, height)
        sizes = [-(-n // 16**k) for k in range(height + 1)]
        assert [len(a) for a in at] == sizes and sorted(np.concatenate(at).tolist()) == list(range(sum(sizes)))
    # height 3: two levels, then each lower subtree on end
    if height == 3:
        at = merkle_manifest.addresses(4096, 3)
        assert at[3][0] == 0 and at[2].tolist() == list(range(1, 17)) and at[1][0] == 17 and at[0][:16].tolist() == list(range(18, 34)) and at[1][1] == 34


def test_manifest_against_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice(["Text A", "b", "ÀÉ Z", "", None]) and f"Text {i} ÀB", rng.choice(["en", None]), rng.choice([None, "", "s", "ß", *(f"s{k}" for k in range(30))]), i) for i in range(600)]
    rows += [(1000 + i, "hot", "en", "hot", 3) for i in range(4200)]  # more than a block
    assert proved_rows(spark, rows) == brute_manifest(rows)


def test_manifest_of_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s1", 0), (4, "One", "en", "s1", 3), (4, "One", "en", "s1", 3), (4, "Two", "en", "s1", 3), (None, "No id", "en", "s2", 5), (5, "Word " * 50_000, "en", "s1", 1)]
    assert proved_rows(spark, rows) == brute_manifest(rows)
    assert proved_rows(spark, rows[:1]) == brute_manifest(rows[:1])
    assert merkle_manifest.proved(spark.createDataFrame([], DOCS)).count() == 0


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(300)], DOCS)
    got = {r.doc_id: r.verified for r in merkle_manifest.proved(docs).collect()}
    assert all(got[i] == (not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0)) for i in got)
