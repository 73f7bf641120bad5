"""The whole pipeline against plain versions of its stages; of toxicity, which has none, the registered query says what goes."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_models import plain_targets
from test_texts import LIBRARY, plain_fingerprint, plain_groups, plain_masked

from twinseek.llm import queries, toxicity


def test_run_is_its_stages_one_after_another(spark, table_folder, rows):
    scores = defaultdict(list)
    for r in queries.op5_toxicity(spark, table_folder).collect():
        scores[r["doc_id"]].append(r["score"])
    clean = [r for r in rows if min(scores[r[0]]) < toxicity.THRESHOLD]
    assert clean and len(clean) > len(rows) // 2
    # rows that share an id may differ in score; the fixture must not depend on which of them stays
    assert all(max(s) < toxicity.THRESHOLD or min(s) >= toxicity.THRESHOLD for s in scores.values())

    groups = plain_groups([plain_fingerprint(r[1]) for r in clean])
    least = {}
    for g, r in zip(groups, clean, strict=True):
        least[g] = min(least.get(g, float("inf")), float("inf") if r[0] is None else r[0])
    candidates = defaultdict(list)
    for g, r in zip(groups, clean, strict=True):
        if least[g] == (float("inf") if r[0] is None else r[0]):
            candidates[g].append(r)
    # one row of each group; where rows tie, any of them
    allowed = {}
    for g, members in candidates.items():
        for r in members:
            text = plain_masked(r[1] or "")
            allowed[r[0], r[2], r[3], tuple(LIBRARY.encode(text, add_special_tokens=False).ids)] = (g, len(text.encode().split()))

    found = corpus_pipeline.run(spark, table_folder).collect()
    taken, times = defaultdict(int), Counter()
    kept = {}
    for r in found:
        key = (r["doc_id"], r["lang"], r["source"], tuple(r["ids"]))
        assert key in allowed, key[:3]
        group, size = allowed[key]
        assert kept.setdefault(group, key) == key
        assert r["exact"] and r["n_tokens"] == len(r["ids"])
        times[group] += 1
        taken[r["source"]] += size
    assert max(times.values()) <= 2
    # every group that was there weighs in the targets, whether the mix takes it or not
    sizes, biggest = defaultdict(int), defaultdict(int)
    for g, members in candidates.items():
        words = {len(plain_masked(r[1] or "").encode().split()) for r in members}
        assert len(words) == 1 or g in kept
        n = allowed[kept[g]][1] if g in kept else words.pop()
        sizes[members[0][3]] += n
        biggest[members[0][3]] = max(biggest[members[0][3]], n)
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= biggest[source]


def test_stages_stand_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "bpe"]
