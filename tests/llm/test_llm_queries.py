"""The registered queries of the subpackage: oracles and brute force on the smallest tables."""

import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import chat, packing, quality, queries, secrets, simhash, tokens
from tracewright.llm import licences as lic

from .test_llm_edges import plain_candidates


@pytest.fixture(scope="module")
def docs(spark, data):
    return [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


def rows(values):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in row] for row in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    at = [names.index(c) for c in order]
    assert rows([r[c] for c in order] for r in df.collect()) == rows([r[k] for k in at] for r in result.fetchall())


def whole_ids(path, texts, end):
    plain = Tokenizer.from_file(path)
    return [np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for t in texts]


def test_op3_packs_whole_documents(spark, data, docs):
    ids = dict(zip([d["doc_id"] for d in docs], whole_ids(tokens.vocabulary("word_bpe_49k.json"), [d["text"] for d in docs], 1), strict=True))
    found = queries.QUERIES["op3_best_fit_packing"](spark, data).collect()
    want = {(doc, k): (at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for doc, x in ids.items() for k, at in enumerate(range(0, len(x), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == packing.simple_best_fit([r["length"] for r in found], 4096)


def test_op4_reads_what_it_wrote(spark, data, docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    at, want = 0, {}
    for d, x in zip(docs, whole_ids(tokens.vocabulary("byte_bpe_50k.json"), [d["text"] for d in docs], 2), strict=True):
        want[d["doc_id"]] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    got = queries.QUERIES["op4_token_planes"](spark, data).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_op5_shards(spark, data, docs):
    got = queries.QUERIES["op5_hypergeometric_shards"](spark, data).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(v) + 8, zlib.crc32(v)) for k, v in raw.items()}


def brute_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, near):
    """Least position reachable over links."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_op7_components(spark, data, docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    fps = [brute_fingerprint(d["text"]) for d in docs]
    roots = linked(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {d["doc_id"]: (f"{f:016x}", docs[r]["doc_id"]) for d, f, r in zip(docs, fps, roots, strict=True)}
    got = queries.QUERIES["op7_simhash_near_dedup"](spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_generalised_pigeonhole_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, size=120, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 8), replace=False)) for b in base for _ in range(3)]
    values = sorted({*map(int, base), *near})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius in (1, 4, 7):
        edges = [(r["a"], r["b"]) for r in simhash.links(table, radius).collect()]
        at = {v: k for k, v in enumerate(signed)}
        joined = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
        pairs = linked(list(range(len(values))), lambda i, j, joined=joined: (i, j) in joined)
        assert pairs == linked(values, lambda a, b, radius=radius: (a ^ b).bit_count() <= radius)


def test_hot_keys_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = sorted({int(x) << 44 for x in rng.integers(0, 1 << 18, size=300)})  # 44 bits are the same for all
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    edges = {frozenset((r["a"], r["b"])) for r in simhash.links(table, 4).collect()}
    at = {v: k for k, v in enumerate(signed)}
    joined = {(at[a], at[b]) for a, b in map(tuple, edges)}
    joined |= {(b, a) for a, b in joined}
    assert linked(list(range(len(values))), lambda i, j: (i, j) in joined) == linked(values, lambda a, b: (a ^ b).bit_count() <= 4)


def test_op10_base_counts(spark, data, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, data).collect()}
    for d in docs:
        text = d["text"] or ""
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        runs = defaultdict(list)
        for i in range(len(words) - 7):
            runs[tuple(words[i : i + 8])].append(i)
        inside = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def plain_judged(rows, share=0.75, prior=100.0):
    """Concentration steps in plain numpy over rows ``(lang, source, base counts, base_failed)``: distances of all."""
    names, every = list(quality._BASE), quality.ALL
    base = np.array([r[2] for r in rows], dtype=float)
    col = {n: base[:, k] for k, n in enumerate(names)}
    levels = lambda r: [(r[0], r[1]), (r[0], every), (every, every)]
    members = defaultdict(list)
    for k, r in enumerate(rows):
        for g in levels(r):
            members[g].append(k)
    parents = {g: [(g[0], every), (every, every)] for g in members}

    def mixed(own, sizes, g):
        """A group's value mixed with its language's, and that with the value of all."""
        lang, top = parents[g]
        low = own[top]
        for h in (lang, g):
            w = sizes[h] / (sizes[h] + prior)
            low = w * own[h] + (1 - w) * low
        return low

    good = {g: [k for k in at if not rows[k][3]] for g, at in members.items()}
    usual, sizes = {}, {}
    for g, at in members.items():
        full = [k for k in at if col["n_words"][k] > 0]
        sizes[g] = len(full)
        meds = []
        for a, b, _ in quality.RATES.values():
            v = [min(np.floor(col[a][k] / col[b][k] * 1000 + 0.5) / 1000, 1000.0) for k in at if col[b][k] > 0]
            meds.append(np.median(v) if v else 0.0)
        usual[g] = np.array(meds)
    own_usual = {g: mixed(usual, sizes, g) for g in members}
    x = np.array([[(col[a][k] + w * own_usual[r[0], r[1]][i]) / (col[b][k] + w) for i, (a, b, w) in enumerate(quality.RATES.values())] for k, r in enumerate(rows)])
    p, floors = len(quality.STATS), np.diag(np.square(quality.FLOORS))
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, p), p + 2)
    params = {}
    for g, at in good.items():
        if at:
            v = np.minimum(np.floor(x[at] * 1000 + 0.5) / 1000, 1000.0)
            low, mid, high = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
            params[g] = (mid, np.diag(1 / (np.square((high - low) / 1.349) + np.square(quality.FLOORS))))

    def distances(at, g):
        d = x[at] - params[g][0]
        return np.einsum("ri,ij,rj->r", d, params[g][1], d)

    for _ in range(20):
        means, scatters, n_in = {}, {}, {}
        for g, at in good.items():
            some = x[:0]
            if at:
                bins = np.floor(np.log1p(np.maximum(distances(at, g), 0)) * 100)
                before = np.array([(bins < b).sum() for b in bins])
                some = x[at][before < share * len(at)]
            n_in[g] = len(some)
            means[g] = some.mean(axis=0) if len(some) else np.zeros(p)
            scatters[g] = factor * np.cov(some.T, bias=True) if len(some) else np.zeros((p, p))
        new, moved = {}, 0.0
        for g in good:
            mean, inverse = mixed(means, n_in, g), np.linalg.inv(mixed(scatters, n_in, g) + floors)
            apart = mean - params[g][0] if g in params else np.full(p, np.inf)
            moved, new[g] = max(moved, apart @ inverse @ apart), (mean, inverse)
        params = new
        if moved < quality.STILL:
            break
    return [float(distances([k], (r[0], r[1]))[0]) for k, r in enumerate(rows)]


def test_op10_equals_brute_force(spark):
    data = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_quality_rules"](spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = []
    for d in docs:
        base = quality.base_counts(d["text"])
        rows.append((d["lang"], d["source"], base, base[0] < 20 or 100 * base[4] > 30 * base[0]))
    limit = quality.chi2_quantile(1 - 1e-7, 5)
    want = {d["doc_id"]: (r[3], x, not r[3] and x <= limit) for d, r, x in zip(docs, rows, plain_judged(rows), strict=True)}
    for r in got:
        failed, x, kept = want[r["doc_id"]]
        assert r["base_failed"] == failed and r["kept"] == kept and abs(r["distance"] - x) <= 1e-3 + 1e-6 * x, (r, x)


def test_op10_separates_labelled_documents(spark):
    data = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = Counter((marks[r["doc_id"]], r["kept"]) for r in queries.QUERIES["op10_quality_rules"](spark, data).filter("not base_failed").collect() if r["doc_id"] in marks)
    assert found[1, False] == 0 and found[0, True] <= 0.05 * (found[0, True] + found[0, False])


def test_op1_finds_the_notices(spark, data, docs):
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in queries.QUERIES["op1_licence_scan"](spark, data).collect()}
    known = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    want = {(d["doc_id"], k): known[line] for d in docs for k, line in enumerate((d["text"] or "").split("\n")) if line in known}
    assert want and {k: got.get(k) for k in want} == want


def plain_licences(text, model):
    """``paragraph: (last line, length, family, predicted, probability, template, similarity)`` of a text, paragraph by paragraph."""
    templates = defaultdict(set)
    for r in lic.template_grams():
        templates[r["family"], r["template"]].add(r["gram"])
    lines = text.split("\n")
    bare = [re.sub(lic._MARKS, "", x, flags=re.ASCII).strip(" ") for x in lines]
    spans = [(k, k, x) for k, x in enumerate(lines)]
    at = 0
    for k in range(len(bare) + 1):
        if k == len(bare) or not bare[k]:
            if k - at > 1:
                spans.append((at, k - 1, " ".join(bare[at:k]).strip(" ")))
            at = k + 1
    found = []
    for first, last, line in spans:
        words = lic.tokens(line)
        own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
        shares = {key: len(own & grams) / len(grams) for key, grams in templates.items()}
        if not any(shares.values()):
            continue
        p = model.probabilities([line])[0]
        best = lic.CLASSES[int(p.argmax())]
        share, template = max([(x, t) for (family, t), x in shares.items() if family == best and x], default=(0.0, None))
        sure = best != "unknown" and p.max() >= model.least and share >= lic.CONFIRM
        found.append((first, last, len(line), best if sure else "unknown", best, round(float(p.max()), 6), template, round(share, 6)))
    one = [r for r in found if r[0] == r[1]]
    several = [r for r in found if r[0] < r[1] and r[3] != "unknown" and not any(x[3] == r[3] and r[0] <= x[0] <= r[1] for x in one)]
    rest = [r for r in one if r[3] != "unknown" or not any(x[0] <= r[0] <= x[1] for x in several)]
    return [(r[0], *r[2:]) for r in rest + several]


@pytest.mark.parametrize("made", [False, True])
def test_op1_equals_brute_force(spark, made):
    model = lic.trained()
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    if made:  # notices wrapped at any width, with comment marks and prose around
        rng, texts = np.random.default_rng(3), lic.paragraphs(6, seed=77)[0]
        docs = []
        for k, text in enumerate(texts):
            wrapped = textwrap.wrap(text, int(rng.integers(20, 90)))
            mark = ("", "# ", "// ", " * ")[k % 4]
            docs.append((k, "\n".join(["some prose", ""][: k % 3] + [mark + x for x in wrapped] + ["", "other prose"][: k % 2 + 1])))
        table = spark.createDataFrame(docs, "doc_id long, text string")
    found = lic.scanned(table, model) if made else queries.QUERIES["op1_licence_scan"](spark, "/root/testdata/sf0.01")
    got = [tuple(r[c] for c in ("doc_id", "paragraph", "length", "family", "predicted", "probability", "template", "similarity")) for r in found.collect()]
    want = [(doc, *r) for doc, text in docs for r in plain_licences(text, model)]
    close = lambda rows: sorted((*r[:5], round(r[5], 5), *r[6:]) for r in rows if r[6]) + sorted((*r[:5], round(r[5], 5), r[7]) for r in rows if not r[6])
    assert want and close(got) == close(want)


def test_op1_held_out_accuracy():
    model = lic.trained()
    texts, y = lic.paragraphs(20, seed=9)
    p = model.probabilities(texts)
    unknown = len(lic.CLASSES) - 1
    passed = (p.argmax(axis=1) != unknown) & (p.max(axis=1) >= model.least)
    assert (p.argmax(axis=1) == y).mean() > 0.97 and passed[y == unknown].mean() <= 0.03


def test_op9_equals_brute_force(spark):
    data = "/root/testdata/sf0.01"
    model, want = secrets.trained(), []
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    for d in docs:
        for a, b, kind in plain_candidates(d["text"] or ""):
            p = float(model.predict(np.array([secrets.features(d["text"], a, b, kind)]))[0])
            want.append((d["doc_id"], a, b - a, kind, round(p, 6), p >= secrets.THRESHOLD))
    got = [tuple(r) for r in queries.QUERIES["op9_secret_scan"](spark, data).collect()]
    assert sorted(got) == sorted(want)
    planted = {(d["doc_id"], m.start(1), len(m.group(1))) for d in docs for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', d["text"] or "")}
    assert planted and planted <= {w[:3] for w in want if w[5]}


def plain_viterbi(model, seen):
    """Best path by dictionaries of scores, state by state."""
    states = range(len(model.start))

    def emitted(o, s):
        return sum(float(table[s, v]) for table, v in zip(model.seen, o, strict=True))

    now, back = {s: float(model.start[s]) + emitted(seen[0], s) for s in states}, []
    for o in seen[1:]:
        best = {s: max(states, key=lambda p, s=s: (now[p] + float(model.moves[p, s]), -p)) for s in states}
        now = {s: now[best[s]] + float(model.moves[best[s], s]) + emitted(o, s) for s in states}
        back.append(best)
    path = [max(states, key=lambda s: (now[s], -s))]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("clean", [False, True])
def test_op2_equals_brute_force_and_recovers_roles(spark, clean):
    data = "/root/testdata/sf0.01"
    raw = queries.raw_transcripts(spark.read.parquet(f"{data}/conversations.parquet"), clean).orderBy("conv_id", "turn")
    fold = raw.filter(F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(5)) == 0)
    held = {r["conv_id"] for r in raw.select("conv_id").distinct().collect()} - {r["conv_id"] for r in fold.select("conv_id").distinct().collect()}
    counts, convs = Counter(), defaultdict(list)
    for r in raw.collect():
        convs[r["conv_id"]].append(r)
    for c, rs in convs.items():
        if c not in held:
            counts.update(chat.label_counts([r["text"] for r in rs], [r["role"] for r in rs]))
    model = chat.Model(counts)
    want, unmarked, right, total, unmarked_right = [], 0, 0, 0, 0
    for c, rs in convs.items():
        lines = [(r["turn"], line) for r in rs for line in r["text"].split("\n")]
        seen = [chat.observe(line, k == 0 or not lines[k - 1][1].strip()) for k, (_, line) in enumerate(lines)]
        found = []
        for (turn, line), s in zip(lines, plain_viterbi(model, seen), strict=True):
            if s % 2 == 0 or not found:
                value, at = chat.marker(line)
                found.append([turn, chat.ROLES[s // 2], line[at if s % 2 == 0 and value == 1 + s // 2 else 0 :]])
            else:
                found[-1][2] += "\n" + line
        part = Counter()
        for turn, role, text in found:
            want.append((c, turn, part[turn], role, text, f"<|{role}|>\n{text.strip(chr(10))}<|end|>"))
            part[turn] += 1
        if c in held:
            first = {turn: role for turn, role, _ in reversed(found)}
            for r in rs:
                bare = chat.marker(r["text"].split("\n")[0])[0] == 0
                total, right = total + 1, right + (first.get(r["turn"]) == r["role"])
                unmarked, unmarked_right = unmarked + bare, unmarked_right + (bare and first.get(r["turn"]) == r["role"])
    got = (chat.formatted(raw.select("conv_id", "turn", "text"), chat.fitted(fold)) if clean else queries.QUERIES["op2_chat_formatting"](spark, data)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    print(f"held-out turns {total}: right {right / total:.4f}; unmarked {unmarked}: right {unmarked_right / unmarked:.4f}")
    # the bounds for clean transcripts are those of before; one in thirty turns of the others has neither a marker nor a blank line before it
    assert (right / total > 0.97 and unmarked_right / unmarked > 0.8) if clean else (right / total > 0.92 and unmarked_right / unmarked > 0.5)
