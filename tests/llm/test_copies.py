"""Decontamination: items that repeat themselves, copies side by side, short items, and the whole query against brute force."""

import random
from itertools import permutations

import pytest

from ontoweave.llm import decontaminate
from ontoweave.llm.decontaminate import Decontamination, drop_leaking, leaks, template

ASK = "Alice has {a} apples and gives {b} apples to Bob. How many of the {a} apples does Alice keep after this gift of {b} to Bob?"
SUMS = "Please work out what 2 plus 3 plus 4 plus 5 plus 6 plus 7 plus 8 plus 9 makes in all."
FILL = "nothing to see but plain words that tell of rivers and of old stones in the valley"
REPEATED = [
    "Ann has 3 red apples and Bob has 4 red apples. How many red apples do Ann and Bob have?",
    "A train leaves Paris at 60 km and another train leaves Rome at 80 km. When do they meet?",
    "A box holds 4 rows of 6 eggs and another box holds 3 rows of 5 eggs. How many eggs are there?",
    "1 2 3 4 5 6 7 8 9 10 11 12",
    SUMS,
    ASK.format(a=5, b=3),
    "What is the capital city of France?",
    "2 + 2 = ?",
    "Why?",
]


def found(spark, items, texts, p=Decontamination()):
    """Item numbers found in each text."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in leaks(docs, bench, p).collect():
        out[r["doc_id"]].add(r["item_id"])
    return out


def test_variants_side_by_side(spark):
    texts = [
        ASK.format(a=5, b=3) + " " + ASK.format(a=9, b=4),
        ASK.format(a=9, b=4) + " " + ASK.format(a=7, b=2),
        " ".join(ASK.format(a=a, b=b) for a, b in ((9, 4), (8, 6), (11, 7), (20, 1))),
        ASK.format(a=9, b=4).replace("and gives", "and very kindly gives") + " " + ASK.format(a=7, b=2).replace("does Alice", "then does Alice"),
    ]
    assert found(spark, [ASK.format(a=5, b=3)], [f"{FILL} {t} {FILL}" for t in texts]) == [{0}] * 4


def test_every_item_is_found_in_its_own_text_and_renamed(spark):
    whole = found(spark, REPEATED, REPEATED + [f"{FILL} {t} {FILL}" for t in REPEATED])
    assert all(i % len(REPEATED) in got for i, got in enumerate(whole))
    others = [
        "It is known that Eve has 7 red apples and Dan has 9 red apples. How many red apples do Eve and Dan have?",
        "It is known that a train leaves London at 70 km and another train leaves Berlin at 90 km. When do they meet?",
        "In that shop a box holds 7 rows of 8 eggs and another box holds 2 rows of 9 eggs. How many eggs are there?",
        SUMS.translate(str.maketrans("23456789", "34567892")),
    ]
    assert [min(x, default=None) for x in found(spark, [*REPEATED[:3], SUMS], others)] == [0, 1, 2, 3]


def test_slots_must_map_one_to_one(spark):
    item = "A shop sells 12 red pens and 3 blue pens to Carol. How many of the 12 red pens and the 3 blue pens does Carol keep?"
    several = item.replace("12", "5").replace("3", "5")  # two numbers become one
    mixed = "A shop sells 9 red pens and 8 blue pens to Carol. How many of the 7 red pens and the 6 blue pens does Carol keep?"
    again = item.replace("12", "40").replace("3 ", "31 ").replace("Carol", "Dora")
    assert found(spark, [item], [f"{FILL}. {t}" for t in (several, mixed, again, item, FILL)]) == [set(), set(), {0}, {0}, set()]


def test_short_items_are_found_word_for_word(spark):
    texts = [f"{FILL}: what is the capital city of France? {FILL}", "What is the capital city of Spain?", "We know 2 + 2 = 4 here", "We know 2 + 3 = 5", "and why, then"]
    assert found(spark, REPEATED[6:], texts) == [{0}, set(), {1}, set(), {2}]


def brute(items, texts, p):
    """``{(text, item)}`` by comparing every window of every text with every window of every item."""

    def bijection(pairs):
        """The most slots that a one-to-one mapping of each kind explains, over all mappings."""
        total = 0
        for kind in {k for k, _, _ in pairs}:
            mine = [(a, b) for k, a, b in pairs if k == kind]
            left, right = sorted({a for a, _ in mine}), sorted({b for _, b in mine})
            flip = len(left) > len(right)
            small, large = (right, left) if flip else (left, right)
            total += max(sum((dict(zip(small, order)).get(b if flip else a) == (a if flip else b)) for a, b in mine) for order in permutations(large, len(small)))
        return total

    def forms(text, begins):
        codes, slots, words, at = template(text, begins)
        cores = [words[i].strip(decontaminate.STRIP).lower() for i in at]
        key = lambda k: tuple(codes[k : k + p.width]) if (slots[k : k + p.width] == 0).sum() >= p.width // 2 else tuple(cores[k : k + p.width])
        return [key(k) for k in range(len(codes) - p.width + 1)], slots, cores

    out = set()
    for i, item in enumerate(items):
        first, slots, cores = forms(item, True)
        inside, inside_slots, _ = forms(item, False)
        kinds = [max(a, b) for a, b in zip(slots, inside_slots)]
        for t, text in enumerate(texts):
            windows, _, mine = forms(text, True)
            if len(cores) < p.least_item:
                if cores and any(mine[k : k + len(cores)] == cores for k in range(len(mine))):
                    out.add((t, i))
                continue
            met = [(d, pos, 0, 0, " ".join(mine[d : d + p.width])) for d, w in enumerate(windows) for pos in range(len(first)) if w in (first[pos], inside[pos])]
            for a in decontaminate.alignments(met, len(cores)):
                covered = {pos + j for _, pos, *_ in a.windows for j in range(p.width)}
                pairs = {(pos + j, d + j) for d, pos, *_ in a.windows for j in range(p.width) if kinds[pos + j]}
                at = {}
                for x, y in sorted(pairs):
                    at.setdefault(x, y)
                slotted = [(kinds[x], cores[x], mine[y]) for x, y in at.items()]
                run = best = 0
                for n, (d, pos, *_) in enumerate(a.windows):
                    run = run + 1 if n and a.windows[n - 1][:2] == (d - 1, pos - 1) else p.width
                    best = max(best, run)
                if len(covered) >= p.coverage * len(cores) or best >= p.run:
                    if all(a == b for _, a, b in slotted) or bijection(slotted) >= p.consistency * len(slotted):
                        out.add((t, i))
    return out


def test_the_whole_query_matches_brute_force(spark):
    r = random.Random(3)
    nouns, verbs, names = "apples pens books coins eggs cards".split(), "gives sells lends shows".split(), "Ann Bob Carol Dan Eve Finn".split()

    def item():
        n = r.choice(nouns)
        part = lambda: r.choice([f"{r.choice(names)} {r.choice(verbs)} {r.randint(2, 40)} {n} to {r.choice(names)}", f"{r.randint(2, 9)} km of road lie between the two", f"there are {r.randint(2, 90)} {n} in the box"])
        return " and ".join(part() for _ in range(r.randint(1, 4))) + f". How many {n} are left?"

    items = [item() for _ in range(25)]
    texts = []
    for _ in range(120):
        base = r.choice(items)
        if r.random() < 0.7:
            table = {w: str(r.randint(2, 60)) for w in map(str, range(100))} if r.random() < 0.7 else {}
            swap = dict(zip(names, r.sample(names, len(names)))) if r.random() < 0.7 else {}
            base = " ".join(table.get(w, swap.get(w, w)) for w in base.split())
        words = base.split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words.insert(r.randrange(len(words) + 1), "indeed")
        texts.append(f"{FILL} {' '.join(words)} {r.choice([FILL, item()])}")
    want = brute(items, texts, Decontamination())
    got = {(t, i) for t, x in enumerate(found(spark, items, texts)) for i in x}
    missed, more = want - got, got - want
    # The greedy mapping of slots may explain less than the best one, never more.
    assert not more and len(missed) <= 0.02 * len(want) and len(want) > 60


def test_reparameterised_items_are_caught_and_others_left(spark):
    """Recall on items with new numbers and names, and precision on sentences of the same words."""
    r = random.Random(8)
    names = "Ann Bob Carol Dan Eve Finn Gil Hal Ida Jon".split()
    ask = [
        "Last year {n} bought {a} boxes with {b} pencils each and lost {c} pencils on the way home. How many pencils does {n} have left of the {a} boxes?",
        "The old bus to {n} drives {a} km in {b} hours and then rests for {c} minutes before it goes back. How far is {n} from here?",
        "Each of the {a} children in the class of {n} eats {b} apples in {c} days. How many apples do the {a} children eat?",
    ]
    fill = lambda q: q.format(n=r.choice(names), a=r.randint(2, 30), b=r.randint(31, 60), c=r.randint(61, 99))
    texts = [f"{FILL}. {fill(q)} {FILL}" for q in ask for _ in range(20)]
    clean = [" ".join(r.sample(fill(r.choice(ask)).split(), 24)) + " " + FILL for _ in range(60)]
    got = found(spark, [fill(q) for q in ask], texts + clean)
    caught, wrong = sum(i // 20 in x for i, x in enumerate(got[:60])), sum(bool(x) for x in got[60:])
    assert caught >= 58 and wrong == 0


def test_rows_that_leak_go_and_no_others(spark):
    docs = spark.createDataFrame([(1, SUMS, "a"), (1, SUMS, "b"), (2, None, "c"), (3, "", "d"), (4, FILL, "e"), (None, f"{FILL} {SUMS}", "f"), (4, FILL, "e")], "doc_id long, text string, _text_key string")
    bench = spark.createDataFrame([(1, SUMS), (1, FILL + " and more of it"), (None, None), (2, "")], "item_id long, text string")
    out = drop_leaking(docs, bench.limit(1))
    assert out.columns == docs.columns and sorted((r["doc_id"], r["_text_key"]) for r in out.collect()) == [(2, "c"), (3, "d"), (4, "e"), (4, "e")]
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in leaks(docs, bench).collect()) == [(0, 1), (1, 1), (4, 1)]
    assert drop_leaking(docs, bench.where("false")).count() == 7 and drop_leaking(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("bits", [1 << 16, 1 << 17])
def test_a_small_filter_changes_nothing(spark, bits):
    items = [ASK.format(a=a, b=b) for a, b in ((5, 3), (9, 4))]
    assert found(spark, items, [FILL, ASK.format(a=7, b=2)], Decontamination(filter_bits=bits)) == [set(), {0, 1}]
