"""The language-model operators on small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, agrees, rows
from pyspark.sql import functions as F

from loomseek.llm import grammars, leakage, origin, packing, queries, ranking, splitting, syntax, textstats


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    agrees(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0


# --- packing


def _best_padding(sizes, counts, k):
    n, best = len(sizes), {}

    def cost(i, j):
        return sum((sizes[j] - sizes[x]) * counts[x] for x in range(i, j + 1))

    prev = [0] + [10**12] * n
    for _ in range(k):
        prev = [0] + [min(prev[i] + cost(i, j - 1) for i in range(j)) for j in range(1, n + 1)]
    return prev[n]


def test_bucket_bounds_are_optimal():
    rnd = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rnd.sample(range(1, 200), 14)))
        counts = np.array([rnd.randrange(1, 50) for _ in sizes])
        for k in (1, 2, 3, 5):
            b = packing.bucket_bounds(sizes, counts, k)
            padding = int(((b[np.searchsorted(b, sizes)] - sizes) * counts).sum())
            assert len(b) <= k and b[-1] == sizes[-1] and padding == _best_padding(sizes.tolist(), counts.tolist(), k)


def test_pack_places_everything_once(spark):
    rnd = random.Random(2)
    docs = [(i, "x" * rnd.choice([0, 1, 7, 50, 60, 99, 100, 101, 250, 300]), 1, 2) for i in range(500)] + [(900, None, 1, 2), (901, "é" * 50, 1, 2), (None, "abc", 1, 2), (902, "y" * 60, 0, 0)]
    docs += docs[:50] + [(1000 + i, "z" * 33, 0, 0) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, bucket int, container int")
    for mix in (True, False):
        p = packing.pack(df, capacity=100, buckets=4, mix=mix)
        got = p.collect()
        size = {d[0]: len((d[1] or "").encode()) for d in docs if d[0] is not None}
        assert sorted({r["id"] for r in got}) == sorted(k for k, n in size.items() if n)
        for i, n in size.items():
            cut = sorted((r["start"], r["end"]) for r in got if r["id"] == i)
            assert sum(e - s for s, e in cut) == n and (n > 100 or len(cut) <= 1)
        f = packing.fill(p, 100).first()
        assert f["over"] == 0 and f["used"] == sum(size.values())
    assert rows(packing.split_items(packing.pack(df, capacity=100)), "id") == sorted(((i,) for i, n in size.items() if n > 100), key=lambda t: str(t[0]))
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill(packing.pack(df.limit(0))).first()["containers"] == 0


def test_little_space_is_left(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, "x" * int(min(4000, rnd.lognormvariate(6.7, 0.9)))) for i in range(3000)], "doc_id bigint, text string")
    assert packing.fill(packing.pack(df)).first()["unused_share"] < 0.02


# --- splitting


@pytest.mark.parametrize("range_bytes", [1, 1000, 1 << 20])
def test_pieces_cover_and_overlap(spark, range_bytes):
    rnd = random.Random(4)
    texts = {
        "plain": "".join(f"line {i} {'x' * rnd.randrange(60)}\n" for i in range(300)),
        "crlf": "".join(f"zeile {i}\r\n" + ("\r\n" if i % 9 == 0 else "") for i in range(200)),
        "oneline": "a;" * 3000,
        "wide": "日本語" * 900,
        "spaces": "word " * 900,
        "fits": "x" * 200,
        "exact": "y" * 400,
    }
    chunks = [("r", "v", "f", k, t, "function", 10, 100, "clash", 3) for k, t in texts.items()]
    chunks += [("r", "v", "f", "none", None, "function", 1, 0, "", 0), ("r", "v", "f", "other", "z" * 9999, "odd", 1, 0, "", 0), ("r", "v", "f", "nokind", "z" * 9999, None, None, None, "", 0)]
    df = spark.createDataFrame(chunks, "repo string, version_id string, file_path string, chunk_id string, text string, kind string, start_line int, start_byte int, max_bytes string, piece int")
    limits = spark.createDataFrame([("function", 400, 2)], "kind string, max_bytes int, overlap_lines int")
    got = {}
    for r in splitting.split_chunks(df, limits, range_bytes).orderBy("chunk_id", "piece").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert sorted(got) == sorted(k for k, t in texts.items() if len(t.encode()) > 400)
    for k, ps in got.items():
        data = texts[k].encode()
        end, shared = 0, 0
        for n, p in enumerate(ps):
            s, e = p["start_byte"] - 100, p["end_byte"] - 100
            assert p["piece"] == n and e - s <= 400 and data[s:e].decode() == p["text"] and s <= end < e
            assert p["start_line"] == 10 + data[:s].count(b"\n") and p["end_line"] == 10 + data[: e - 1].count(b"\n")
            shared += data[s:end].count(b"\n")
            end = e
        assert end == len(data)
        if k != "wide" and len(ps) > 1:
            assert min(p["end_byte"] - p["start_byte"] for p in ps) >= 100
        if k in ("plain", "crlf"):
            assert shared >= 1.8 * (len(ps) - 1)
            assert all(p["text"].endswith("\n") for p in ps)
    assert splitting.split_chunks(df.limit(0), limits).count() == 0 and splitting.split_chunks(df, limits.limit(0)).count() == 0


def test_pieces_of_files(spark, tmp_path):
    """Files by ranges give the pieces that rows give, whatever the size of the ranges."""
    rnd = random.Random(15)
    big = "".join(f"line {i} {'é' * rnd.randrange(60)}\n" + ("\n" if i % 7 == 0 else "") for i in range(3000))
    texts = {"big.txt": big, "one.txt": "a;" * 40000, "small.txt": "x\ny\n", "empty.txt": "", "b c.txt": "日本語" * 9000}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    seen = []
    for range_bytes in (1, 60_000, 1 << 20):
        files = splitting.list_files(spark, str(tmp_path))
        got = splitting.split_files(files.unionByName(files), 300, 2, range_bytes)
        seen.append(rows(got, "path", "piece", "offset", "end_offset", "line", "end_line", "piece_text"))
    assert seen[0] == seen[1] == seen[2]
    by_file = {}
    for path, *rest in seen[0]:
        by_file.setdefault(path.rsplit("/", 1)[1].replace("%20", " "), []).append(rest)
    assert set(by_file) == set(texts) - {"empty.txt"} and len(by_file["small.txt"]) == 1
    df = spark.createDataFrame([("r", "v", k, k, t, "any", 0, 0) for k, t in texts.items()], "repo string, version_id string, file_path string, chunk_id string, text string, kind string, start_line int, start_byte int")
    limits = spark.createDataFrame([("any", 300, 2)], "kind string, max_bytes int, overlap_lines int")
    in_rows = {}
    for r in splitting.split_chunks(df, limits).collect():
        in_rows.setdefault(r["chunk_id"], []).append([r["piece"], r["start_byte"], r["end_byte"], r["start_line"], r["end_line"], r["text"]])
    assert {k: sorted(v) for k, v in in_rows.items()} == {k: sorted(v) for k, v in by_file.items() if k != "small.txt"}


def test_pieces_need_no_shuffle(spark):
    df = spark.read.parquet(f"{DATA}/chunks.parquet")
    plan = splitting.split_chunks(df, spark.read.parquet(f"{DATA}/chunk_limits.parquet").hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


# --- leakage


def _brute_winnow(text, k, w):
    t = leakage.normalised(pa.array([text]))[0].as_py().encode()
    grams = [t[i : i + k] for i in range(len(t) - k + 1)]
    return len(grams)


def test_every_long_shared_span_shares_a_fingerprint():
    rnd = random.Random(7)
    letters = "abcdefghij klm"
    for _ in range(60):
        span = "".join(rnd.choice("abcdefghijklm") for _ in range(leakage.K + leakage.WINDOW - 1))
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) + span + "".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(2))
        t, _, h = leakage._fingerprints(pa.array([a, "", None, b, "short"]))
        assert set(h[t == 0].tolist()) & set(h[t == 3].tolist()) and not (t == 1).any() and not (t == 4).any()


def test_winnow_density():
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000))
    _, _, h = leakage._fingerprints(pa.array([text]))
    assert abs(len(h) / _brute_winnow(text, leakage.K, leakage.WINDOW) - 2 / (leakage.WINDOW + 1)) < 0.02


ITEM = "Count the ways to paint 832 spools from 50 shades so that no colour repeats among siblings. Moving seeds through a spiral stair takes 43 units per metre plus the depth of whatever waits between. Report the least age that allows all bricks to leave a floating raft before 761 ticks."


def test_leaks(spark):
    w = ITEM.split()
    half = len(w) // 2
    docs = [
        (1, "Intro text here.\n\n> " + ITEM.upper().replace(" ", "\n> ") + "\n\nand more"),
        (2, " ".join(w[: half + 6]) + " and then something else entirely follows"),
        (3, " ".join(x if i % 8 else "other" for i, x in enumerate(w))),
        (4, " ".join(w[:10]) + " a short quotation only, nothing else of it is in this text at all"),
        (5, " ".join(sorted(w))),
        (6, None),
        (7, ""),
        (8, "<p>" + ITEM.replace(" the ", " <b>the</b> ") + "</p>"),
        (9, ("filler words of no import. " * 3000) + ITEM + (" tail" * 3000)),
        (1, "Intro text here.\n\n> " + ITEM.upper().replace(" ", "\n> ") + "\n\nand more"),
        (10, ITEM),
        (11, ITEM),
        (12, ITEM.replace("ra", "r\u00ada").replace("th", "t\u200bh").replace(" 832 ", " &#56;32 ")),
        (13, "\\n".join(w)),
        (None, ITEM),
    ]
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id bigint, text string, item_id int, h string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (1, ITEM), (5, "An item that nobody holds, about harbours and cranes and long cold winters in the north of the country.")], "item_id bigint, text string")
    assert rows(leakage.leaks(d, items), "doc_id", "item_id") == sorted(((i, 1) for i in (1, 2, 3, 8, 9, 10, 11, 12, 13)), key=lambda t: (False, str(t[0])))
    assert leakage.leaks(d.limit(0), items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0


def test_short_items_and_far_halves_leak(spark):
    """Items of one fingerprint or none, and an item whose halves stand far from each other."""
    half = ITEM.split()
    far = " ".join(half[: len(half) // 3]) + " filler of no import" * 3000 + " " + " ".join(half[len(half) * 2 // 3 :])
    docs = [(1, "Well: the moon pays rent twice, they say."), (2, "the rent pays moon twice"), (3, "x tiny mark y"), (4, "nothing"), (5, far), (6, "tinymarket"), (7, "1, 2, go!")]
    items = [(1, "The moon pays rent twice"), (2, "Tiny mark"), (3, ITEM), (4, "..."), (5, "1 2 go")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(leakage.leaks(d, i), "doc_id", "item_id") == [(1, 1), (3, 2), (5, 3), (7, 5)]


def test_alignment_by_rows(monkeypatch):
    rnd = random.Random(14)
    for _ in range(300):
        item = [rnd.choice("ab") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 15))]
        doc = [rnd.choice("ab") * rnd.randrange(1, 3) for _ in range(40)]
        want = leakage.held_share(item, doc)
        with monkeypatch.context() as m:
            m.setattr(leakage, "MANY_PAIRS", 0)
            assert abs(leakage.held_share(item, doc) - want) < 1e-9, (item, doc)
    assert leakage.held_share(["a"] * 300, ["a"] * 20000) == 1.0


def test_held_share_matches_a_plain_alignment():
    rnd = random.Random(9)

    def plain(item, doc, run=3):
        # longest chain of matching positions in which every matched word lies in a run of ``run``
        n, m = len(item), len(doc)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                v = max(best[i - 1][j], best[i][j - 1])
                length, x = 0, 0
                while i - length > 0 and j - length > 0 and item[i - 1 - length] == doc[j - 1 - length]:
                    x += len(item[i - 1 - length])
                    length += 1
                    if length >= run:
                        v = max(v, best[i - length][j - length] + x)
                best[i][j] = v
        return best[n][m] / sum(map(len, item))

    for _ in range(200):
        item = [rnd.choice("abcde") * rnd.randrange(1, 3) for _ in range(14)]
        doc = [w for w in item if rnd.random() < 0.85] + [rnd.choice("abcde") for _ in range(6)]
        assert abs(leakage.held_share(item, doc) - plain(item, doc)) < 1e-9
    assert leakage.held_share([], ["a"]) == 0.0 and leakage.held_share(["a"], []) == 0.0 and leakage.held_share(["a", "b"], ["x", "a", "b"]) == 1.0


# --- text types

PROSE = [
    "We agreed to keep the old queue until the end of the month and then to archive it. The report was wrong in a boring way, because it counted each scheduler twice.",
    "they wanted the cache to survive a restart which is why it lives next to the session\nfor now the simplest choice is to leave it alone and to review the posting that calls it",
    "> Das Ergebnis hängt vor allem von der Größe des Puffers ab. Wir haben die alte Fassung behalten, weil sie auch ohne Netz lesbar bleibt.",
    "失敗した場合でも、前の版はそのまま残ります。処理には約1160秒かかりますが、結果は常に同じです。",
    "大约1685秒之后，任务会自动结束。如果缓存为空，系统会重新读取索引。我们发现问题出在重复写入的记录上。",
    "**Each** _of_ the 491 helpers _hauls_ at most 11 masks, and a **helper** tires once the __depth__ passes it. We kept the old queue because it is *easy* to trust.",
    "Il vaut mieux corriger le code que d'ajouter une exception de plus.\n\n- un\n- deux\n\nLa réponse dépend surtout de la taille du tampon, et nous avons choisi cette forme parce qu'elle reste lisible.",
]
JUNK = [
    "- queue\n- cache of tokens\n* parser\n- worker\n- shard index\n- token\n" * 3,
    "offset,total,state,name\nmanifest,1816,30.84,detach\nsession,5022,67.24,part\n" * 4,
    "| 4539 | vector | posting | 0.783 |\n| 0.604 | n/a | n/a | n/a |\n" * 6,
    "1.1 What a vector is for ...................... 3\n1.2 Notes on a replica .............................. 4\n" * 3,
    "~" * 300,
    "8/WiIWqg7DJFPr7M156Udq7iGABZHiHe3Y0B8HdtcZmSaxAsFBF8lTzYaTntctaPfZ5PTfXy0k3X2aApwz4GxJpH6jOMlAy0" * 3,
    "function f(ctx, opts = {}) {\n  ctx.id = ctx?.limit ?? {};\n  if (f(ctx) === null) {\n    return { ok: false };\n  }\n}\n" * 3,
    "窓口、12、索引、0.5\n窓口\t索引\t窓口\nキュー｜索引｜任务\n" * 6,
    "2025-01-01T00:00:01Z INFO worker=3 id=77 ok\n2025-01-01T00:00:02Z WARN worker=4 id=78 slow\n" * 5,
]
NO_WORDS = np.zeros(0, np.int64)


def test_text_types(spark):
    docs = [(i, t, 0, "p") for i, t in enumerate(PROSE * 12)] + [(1000 + i, t, 0, "j") for i, t in enumerate(JUNK * 4)] + [(5000, None, 0, ""), (5001, "", 0, ""), (5002, " \n\t　", 0, ""), (None, "x", 0, "")]
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, votes int, words string").repartition(3)
    got = textstats.text_types(textstats.text_statistics(df)).select("id", "p_prose").distinct().collect()
    assert len(got) == 12 * len(PROSE) + 4 * len(JUNK)
    assert not [r for r in got if (r["p_prose"] >= 0.5) != (r["id"] < 1000)]
    assert textstats.text_types(textstats.text_statistics(df.limit(0))).count() == 0


LANGUAGES = [
    "Вчера вечером мы долго гуляли по старому городу и говорили о том, как изменилась наша жизнь. Никто не знал, что будет дальше.",
    "Ontem à noite caminhamos pela cidade velha e conversamos sobre como a nossa vida mudou. Ninguém sabia o que viria depois.",
    "Wczoraj wieczorem długo spacerowaliśmy po starym mieście i rozmawialiśmy o tym, jak zmieniło się nasze życie. Nikt nie wiedział, co będzie dalej.",
    "어제 저녁 우리는 오래된 도시를 오랫동안 걸으며 우리의 삶이 어떻게 변했는지 이야기했다. 앞으로 무슨 일이 일어날지 아무도 몰랐다.",
    "مساء أمس مشينا طويلا في المدينة القديمة وتحدثنا عن كيف تغيرت حياتنا في السنوات الأخيرة. لم يعرف أحد ماذا سيحدث بعد ذلك.",
    "Dün akşam eski şehirde uzun süre yürüdük ve hayatımızın nasıl değiştiğini konuştuk. Kimse bundan sonra ne olacağını bilmiyordu.",
    "I går kväll gick vi länge i den gamla staden och talade om hur vårt liv hade förändrats. Ingen visste vad som skulle hända sedan.",
    "Ieri sera abbiamo camminato a lungo nella città vecchia e abbiamo parlato di come la nostra vita è cambiata. Nessuno sapeva nulla.",
    "เมื่อคืนนี้เราเดินเล่นในเมืองเก่าเป็นเวลานานและพูดคุยกันว่าชีวิตของเราเปลี่ยนไปอย่างไรในช่วงไม่กี่ปีที่ผ่านมา",
    "कल शाम हम पुराने शहर में देर तक घूमते रहे और इस बारे में बात करते रहे कि हमारा जीवन कैसे बदल गया। किसी को नहीं पता था कि आगे क्या होगा।",
]
MORE_JUNK = [
    "21:55:14,032 INFO flattenLatch: The payload of the graph is empty.\nT11:54:35,749 WARN probePylon: The fixture of the adapter was renewed.\n" * 6,
    "is the lease on?\nwhere the vector is kept\nthe chunk of a fixture\na shard for each token\nhow to empty the queue\n" * 4,
    "ok " * 90,
    "lol " * 60,
]


@pytest.mark.parametrize("beside", [0, 12])
def test_prose_of_any_language(spark, beside):
    """Languages the corpus does not hold otherwise, alone and beside English."""
    docs = [(i, t) for i, t in enumerate(LANGUAGES)] + [(1000 + i, t) for i, t in enumerate(MORE_JUNK + JUNK)] + [(2000 + i, t) for i, t in enumerate(PROSE * beside)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = textstats.text_types(textstats.text_statistics(df)).select("id", "p_prose").collect()
    assert len(got) == len(docs)
    assert not sorted(r["id"] for r in got if (r["p_prose"] >= 0.5) == (1000 <= r["id"] < 2000))


def test_statistics_match_a_plain_count():
    rnd = random.Random(11)
    pool = PROSE + JUNK + ["", "\n", "x", "\n\n a\n", "é", " lead", "The, 'the' (the) \"of\" and-and"]
    for _ in range(20):
        texts = [rnd.choice(pool) for _ in range(rnd.randrange(1, 12))]
        data = "".join(texts).encode()
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        got = textstats.byte_statistics(np.frombuffer(data, np.uint8), offsets, NO_WORDS)
        for i, t in enumerate(texts):
            b = t.encode()
            words = b.split()
            assert got["words"][i] == len(words) and got["n_bytes"][i] == len(b)
            assert got["digits"][i] == sum(48 <= c < 58 for c in b) and got["lines"][i] == sum(bool(x.split()) for x in b.split(b"\n"))
        whole = {k: v for k, v in got.items()}
        for i, t in enumerate(texts):
            b = t.encode()
            alone = textstats.byte_statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]), NO_WORDS)
            assert all(alone[k][0] == whole[k][i] for k in textstats.STATS), (t, [(k, alone[k][0], whole[k][i]) for k in textstats.STATS if alone[k][0] != whole[k][i]])


# --- grammars

VALID_JS = """
import a, { b as c } from './x.js'; import * as d from "y"; export { c }; export default class extends a {}
const { x, y: [z = 1, ...w], ...rest } = f(); let q = a ?? b, r = a?.b?.[c]?.(d);
async function* g(a, { b }, ...c) { for await (const x of y) yield* x; await h(); }
class K extends (class {}) { #p = 1; static s; static { this.s = 2 } get v() { return this.#p } async *m() {} [k]() {} 'str'() {} }
const re = /[)}\\]"]+/g.test(s) / 2, t = `a${b + `c${{ d: 1 }.d}`}e`, o = { get a() { return 1 }, async b() {}, [c]: d, e, ...f, 'g': 1 };
label: for (var i = 0, n = 2; i < n; i++) { if (i) continue label; else break }
for (const k in o) ; do x++; while (x < 5) switch (x) { case 1: default: y; }
try { throw new Error } catch { } finally { }
(async () => { await 1 })(); x = y => ({ z: y }); a = b ? c : d; a **= 2; if (a) b; else c
new.target; new (foo())(); delete a.b, void 0, typeof x; [a, b] = [b, a]; ({ a, b: c } = d)
a
++b
""".replace("new.target; ", "")

VALID_TS = """
import type { A } from './a'; export type B<T extends object = {}> = { readonly [K in keyof T]?: T[K] } | null;
interface C<T> extends D, E<T> { a: number; b?(x: string): void; [k: string]: any; new (x: number): C<T>; readonly c: string[] }
enum F { A = 1, B, 'C' = 3 } declare const g: unique symbol; abstract class H<T> implements C<T> { private readonly a: number = 1; constructor(public b?: string) { super() } abstract m(): void; declare d: string }
function f(this: Window, a?: number, ...b: string[]): a is number { return (a as any)!.b satisfies unknown }
function f2(x: string): void; function f2(x: any) { }
const h = <T,>(x: T): Promise<Array<T>> => x as any; let i: (a: number) => void = (a: number): void => { }; let t: [a: string, b?: number] = g<string>(1);
namespace N.M { export const x = 1 } type P = A extends infer U ? U : never; let k: typeof import('x'); let neg: -1 | 'a' | `b${string}`;
for (const x of y as any[]) { } export = f
"""


@pytest.mark.parametrize("line", [x for x in VALID_JS.strip().split("\n")])
def test_javascript_accepts(line):
    assert grammars.valid("javascript", line)


@pytest.mark.parametrize("line", [x for x in VALID_TS.strip().split("\n")])
def test_typescript_accepts(line):
    assert grammars.valid("typescript", line)


def test_whole_programs():
    assert grammars.valid("javascript", VALID_JS) and grammars.valid("typescript", VALID_TS) and grammars.valid("javascript", "#!/usr/bin/env node\r\nlet a = 1\r\nlet b = 2\r\n") and grammars.valid("javascript", "")


@pytest.mark.parametrize(
    "text",
    [
        "let a = ;", "function (", "retrun x;", "a b", "if (a) {", "x = 'abc", "x = `abc${", "class A { b c }", "{ a: 1, b }; let x = { a: 1 b: 2 };", "<<<<<<< HEAD\nlet a;\n=======\n>>>>>>> b\n",
        "import x", "export { a b }", "for (;;", "return 1;", "break;", "1 = 2;", "a + b = c;", "let x = 08n", "try { }", "switch (x) { default: default: }", "const a;", "f(a,, b)", "let interface X { }",
        "def f(x):\n    return x\n", "\x00", "var a = 1 var b = 2", "async function f() { } await", "function f() { await x; }", "{ \"a\": 1 }", "opts . = 6", "/* open", "x = /abc", "a => { } ()", "a?.b = 1", "({ a = 1 });", "let [a];", "interface A { b: string }",
    ],
)
def test_javascript_refuses(text):
    assert not grammars.valid("javascript", text)


@pytest.mark.parametrize("text", ["interface A { b: }", "type A = ;", "let x: = 1;", "enum { A }", "function f(a: number b) { }", "let a: number[ = 1;"])
def test_typescript_refuses(text):
    assert not grammars.valid("typescript", text)


@pytest.mark.parametrize("text, want", [('{"a": [1, null, "x"]}', True), ("", False), ("{'a': 1}", False), ('{"a": NaN}', False), ('{"a": 1,}', False), ("// c\n{}", False), ("[" * 100000, False), ('"\\u00e9"', True)])
def test_json(text, want):
    assert grammars.valid("json", text) == want


@pytest.mark.parametrize("text, want", [("def f():\n    return 1\n", True), ("print 'x'", False), ("def f():\nreturn 1", False), ("x = (1", False), ("", True), ("a\x00b", False), ("(" * 5000, False)])
def test_python(text, want):
    assert grammars.valid("python", text) == want


def test_deep_templates():
    deep = "const a = `${xs.map(x => { if (x) { for (const y of x) { f(`${y ? `n${`d${`e${1}`}`}`:''}`); } } return x; })}`;"
    assert grammars.valid("javascript", deep) and not grammars.valid("javascript", deep[:-2]) and not grammars.valid("javascript", deep.replace("f(", "f((", 1))


def test_verdicts():
    assert syntax.verdict("javascript", "let a = 1;")[::3] == (True, ["javascript", "typescript"])
    assert syntax.verdict("javascript", "interface A { b: string }\n")[1:3] == ("wrong extension", "typescript")
    assert syntax.verdict("typescript", "def f(self):\n    return None\n")[1:3] == ("wrong extension", "python")
    assert syntax.verdict("python", '{"a": null,\n "b": [1, 2]}')[:3] == (True, "valid", "python") and syntax.verdict("json", "x = (")[1] == "corrupt"


def test_parsed_files(spark):
    files = [("r", "a.js", "let a = 1;"), ("r", "b.js", "def f(x):\n    return None\n"), ("r", "c.py", "x = ("), ("r", "d.json", "{}"), ("r", "e.txt", "?"), ("r", "f.js", None), (None, "g.ts", "let a: number;"), ("r", "a.js", "let a = 1;"), ("r", "h.mjs", "x;" * 200000), ("r", "not-a-symbol.js", "(")]
    f = spark.createDataFrame([(*x, "c", True) for x in files], "repo string, file_path string, content string, language string, valid boolean")
    s = f.filter("file_path <> 'not-a-symbol.js'").select("repo", "file_path", "language")
    got = syntax.parsed_files(s, f)
    assert rows(got, "file_path", "valid", "verdict") == [("a.js", True, "valid"), ("b.js", False, "wrong extension"), ("c.py", False, "corrupt"), ("d.json", True, "valid"), ("g.ts", True, "valid"), ("h.mjs", True, "valid")]
    assert syntax.parse_rates(got).agg(F.sum("invalid")).first()[0] == 2
    assert syntax.parsed_files(s.limit(0), f).count() == 0 and syntax.parsed_files(s, f.limit(0)).count() == 0


# --- origins

HAND = "import { a } from './a.js';\n// The minified build of this module is published elsewhere.\nconst BANNER = '// Code generated by the exporter. DO NOT EDIT.';\nexport function resolveLantern(state, options) {\n  const spindle1 = a(state);\n  return options.owner || spindle1;\n}\nfunction mergeHarbor(entry) {\n  return entry.items.map((item) => item.price);\n}\n"


def test_origins(spark):
    minified = "".join(f"function {x}{y}(e,t){{var n=e.weight;return n?t(n):void 0}}var {y}{x}=function(e){{return e&&e.depth}};" for x in "qxzjkv" for y in "wyfgbn")
    numbered = "".join(f"function {v}{n}{i}(input) {{\n  return input.{n};\n}}\n" for i, (v, n) in enumerate([("restore", "Sensor"), ("seal", "Journal"), ("merge", "Cobalt"), ("expand", "Ember")]))
    slots = "".join(f"exports.getField_Token_{i} = function (msg, arg) {{ return msg.$slot({i}, 0, arg); }};\n" for i in range(40))
    bundle = "(function (modules) {\n  return __req__(0);\n})({\n/***/ 0:\n/***/ (function (module, exports, __req__) {\nfunction resolveToken(state) { return state; }\n/***/ })\n});\n"
    data = "module.exports = [\n" + "".join(f'  {{"code": "VEC-{i}", "lat": {i}.5}},\n' for i in range(50)) + "];\n"
    base64 = "export const FONT =\n  'Xmulyi5miol//c8JVcjK8EAJuivVVFwTyGYgTW5xvGnAIAvcyWU1BvGScE2U8Y0OJzRM5usvZMdFI" + "Qz9k" * 100 + "';\n"
    files = {
        "src/vendors/a.js": (HAND, "hand-written"), "src/b.js": (minified, "minified"), "src/c.js": ("// @generated\n" + numbered, "generated"), "src/numbered.js": (numbered, "hand-written"), "src/m.js": ("/*!\n * tinylib 6.5.16\r\n * Copyright (c) 2015 the authors\n */\n" + numbered, "vendored"), "src/d.js": (slots, "generated"), "src/e.js": (bundle, "bundled"),
        "src/f.js": (data, "data"), "src/g.js": (base64, "data"), "node_modules/x/h.js": (numbered, "vendored"), "src/i.js": ("/*!\n * Copied from x@1.2.3 (A Ltd), upstream license: MIT\n */\n" + HAND, "vendored"),
        "src/j.py": ("# @generated\ndef f(x):\n    return x\n", "generated"), "src/k.js": ("", "hand-written"), "src/l.js": ("const help = '" + "use the queue only when " * 60 + "';\nfunction showHelp() { return help; }\n", "hand-written"),
    }
    extra = {f"src/more{i}.js": (HAND.replace("Lantern", w), "hand-written") for i, w in enumerate(["Harbor", "Packet", "Vertex", "Meadow", "Socket", "Bundle", "Ticket", "Window"] * 5)}
    rows_ = [("r", p, t, 1, f"id{p}", "x", 0) for p, (t, _) in {**files, **extra}.items()] + [("r", "z.json", "{}", 1, "j", "", 0), ("r", None, "x", 1, "n", "", 0), ("r", "src/null.js", None, 1, "m", "", 0), (None, "src/n.js", HAND, None, "o", "", 0)]
    df = spark.createDataFrame(rows_ + rows_[:3], "repo string, file_path string, text string, start_line int, chunk_id string, names string, bits int")
    got = {r["file_path"]: r["origin"] for r in origin.file_origins(df).collect()}
    want = {p: k for p, (_, k) in {**files, **extra}.items()} | {"src/n.js": "hand-written"}
    assert got == want
    assert origin.file_origins(df.limit(0)).count() == 0


def test_names_alone_decide(spark):
    """Files without any mark, against the names of a corpus: random names, accessors of few stems, a library of another style."""
    rnd = random.Random(3)
    chunks = spark.read.parquet(DATA.replace("0.001", "0.01") + "/chunks.parquet").select("repo", "file_path", "text", "start_line", "chunk_id")
    three = "\n".join("function " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) + "(a, b) {\n  return a + b;\n}" for _ in range(40))
    accessors = "\n".join(f"function {v}{s}(node) {{\n  return node.{s.lower()};\n}}" for s in ("Owner", "Token", "Window", "Ledger") for v in ("get", "set", "has", "clear", "reset"))
    w = "manifest shard voucher lantern cursor tariff bundle harbor socket spindle ember quill prism gasket orbit".split()
    verbs = "restore seal merge expand verify drain route stage probe attach shrink rotate tally decode".split()
    snake = "\n".join(f"function {verbs[i]}_{w[i]}(self) {{\n  return self;\n}}" for i in range(14))
    planted = [("quiet-heron-0", f"src/planted/{n}.js", t, 1, n) for n, t in (("three", three), ("accessors", accessors), ("snake", snake))]
    got = origin.file_origins(chunks.unionByName(spark.createDataFrame(planted, chunks.schema))).filter("file_path like 'src/planted/%'")
    assert rows(got, "file_path", "origin", "evidence") == [("src/planted/accessors.js", "generated", "names"), ("src/planted/snake.js", "vendored", "names"), ("src/planted/three.js", "minified", "names")]


def test_foreign_style_is_vendored(spark):
    copy = "".join(f"function {v}_{n}(input_value) {{\n  return input_value.{n};\n}}\n" for v, n in [("restore", "sensor"), ("seal", "journal"), ("merge", "cobalt"), ("expand", "ember"), ("drain", "lease"), ("route", "quill"), ("stage", "prism"), ("probe", "gasket")])
    words = [a + b for a in ("Harbor", "Packet", "Vertex", "Meadow", "Socket", "Bundle") for b in ("Owner", "Store", "Reader", "Writer", "Index", "Lease", "Queue", "Graph")]
    files = {f"src/own{i}.js": HAND.replace("Lantern", w) for i, w in enumerate(words)} | {"src/copy.js": copy, "src/tied.js": "import { a } from './own0.js';\n" + copy}
    # in a repository of that very style it is no copy
    rows_ = [("r", p, t, 1, p) for p, t in files.items()] + [("s", f"src/{i}.js", copy, 1, f"s{i}") for i in range(4)]
    schema = "repo string, file_path string, text string, start_line int, chunk_id string"
    # the names of a corpus, so that words of this one are not strange
    corpus = spark.read.parquet(DATA.replace("0.001", "0.01") + "/chunks.parquet").select("repo", "file_path", "text", "start_line", "chunk_id")
    df = spark.createDataFrame(rows_, schema).unionByName(corpus)
    assert rows(origin.file_origins(df).filter("origin <> 'hand-written' AND repo IN ('r', 's')"), "repo", "file_path", "origin") == [("r", "src/copy.js", "vendored")]


# --- ranking


def test_fused_ranking(spark):
    data = [("q", "dense", c, 0.7 + 0.01 * i) for i, c in enumerate("abcde")] + [("q", "sparse", c, 10.0**i) for i, c in enumerate("abcde")] + [("q", "rerank", c, -5.0 + i) for i, c in enumerate("edcba")]
    data += [("q", "sparse", "a", float("nan")), ("q", "sparse", "b", None), ("q", "dense", "a", 0.7), ("q", None, "a", 1.0), (None, "dense", "a", 1.0), ("p", "structural", "x", 0.5), ("p", "structural", "y", 0.5), ("n", "dense", "z", float("nan")), ("i", "dense", "u", float("inf")), ("i", "dense", "v", 1.0), ("i", "dense", "w", 0.0)]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in data], "query_id string, signal string, chunk_id string, score double, rank int, w double")
    got = ranking.fused_ranking(df)
    r = {x["chunk_id"]: x for x in got.filter("query_id = 'q'").collect()}
    assert sorted(x["rank"] for x in r.values()) == [1, 2, 3, 4, 5] and all(0 < x["final_score"] < 1 for x in r.values())
    assert rows(got.filter("query_id = 'p'"), "chunk_id", "final_score", "rank") == [("x", 0.5, 1), ("y", 0.5, 2)]
    assert {x["query_id"] for x in got.select("query_id").collect()} == {"q", "p", "i"}
    assert ranking.fused_ranking(df.limit(0)).count() == 0


@pytest.mark.parametrize("together", [0, 15, 10**6])
def test_large_queries_rank_alike(spark, together):
    rnd = random.Random(16)
    data = [(f"q{q}", s, f"c{i}", rnd.choice([rnd.gauss(0, 9), 1.0, 2.0, float("inf")])) for q, n in enumerate([3, 5, 40, 1]) for s in ("dense", "sparse", "rerank") for i in range(n)]
    df = spark.createDataFrame(data + data[:9], "query_id string, signal string, chunk_id string, score double")
    cols = ["query_id", "chunk_id", "final_score", "rank", "n_signals"]
    assert rows(ranking.fused_ranking(df, together=together), *cols) == rows(ranking.fused_ranking(df, together=20), *cols)


def test_no_signal_rules_by_its_range(spark):
    rnd = random.Random(6)
    data = [("q", s, f"c{i}", rnd.random()) for s in ("dense", "sparse", "rerank") for i in range(40)]
    schema = "query_id string, signal string, chunk_id string, score double"
    plain = rows(ranking.fused_ranking(spark.createDataFrame(data, schema)), "chunk_id", "rank")
    scaled = [(q, s, c, x * (1e6 if s == "sparse" else 1) + (5 if s == "rerank" else 0)) for q, s, c, x in data]
    assert rows(ranking.fused_ranking(spark.createDataFrame(scaled, schema)), "chunk_id", "rank") == plain


def test_ndcg(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 3.0), ("q", "c", 1.0), ("p", "a", 1.0)], "query_id string, chunk_id string, grade double")
    assert ranking.ndcg(run, qrels).first()["ndcg"] == round((3 / np.log2(3)) / (3 + 1 / np.log2(3)) / 2, 6)


# --- very long texts


def test_long_documents_in_parts(monkeypatch):
    rnd = random.Random(12)
    text = "".join(rnd.choice(PROSE + JUNK) + "\n" for _ in range(300))
    b = text.encode()
    whole = textstats.byte_statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]), NO_WORDS)
    monkeypatch.setattr(textstats, "STEP_BYTES", 1000)
    shared = type("Shared", (), {"value": NO_WORDS})
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a b", text, "c"])], names=["id", "text"])
    out = pa.Table.from_batches(list(textstats._stat_batches([batch], pa.int64(), shared))).to_pydict()
    assert out["id"] == [1, 2, 3] and out["words"] == [2, int(whole["words"][0]), 1]
    assert all(out[k][1] == whole[k][0] for k in textstats.STATS)


def test_long_texts_keep_their_fingerprints(monkeypatch):
    rnd = random.Random(13)
    text = "".join(rnd.choice("abcdefghijklmnop") for _ in range(5000))
    whole = set(leakage._fingerprints(pa.array(["x", text]))[2].tolist())
    monkeypatch.setattr(leakage, "STEP_BYTES", 700)
    t, _, h = leakage._fingerprints(pa.array(["x", text]))
    assert whole <= set(h.tolist()) and set(t.tolist()) == {1}


def test_deep_nesting_is_valid():
    assert grammars.valid("javascript", "x = " + "(" * 900 + "1" + ")" * 900 + ";") and grammars.valid("javascript", "if (a) {" * 900 + "}" * 900)
    assert not grammars.valid("javascript", "x = " + "(" * 900 + ")" * 900 + ";")
