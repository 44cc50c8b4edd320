"""Scoring sequences with ordered pattern-rule models.

At each position of a sequence the first rule (in stored order) whose pattern, or
its reverse, starts there and fits contributes its weight once; a model's
prediction is the sum of these weights, 0 without a hit.

The default form turns the substring test into an equi-join: sequences become
their k-grams of the lengths that occur in the rules, rules become the distinct
strings {pattern, reverse}, and the earliest rule of each position is an
aggregation.  Sequences are dealt out by their id once; rules of up to
``BROADCAST_ROWS`` rows (they are counted) are broadcast, so the k-grams, the
positions' first rules and the sums of a sequence stay in its task and are never
shuffled.  Larger rule sets go to multi-pattern automata, part by part.

Where only sums are asked for (``model_sums``, ``position_sums``), no hit becomes a
row: the rules' strings form tries, the node at which a position's letters leave a
trie decides the first rule of every model there, and tasks add the weights of nodes
sequence by sequence.  Rule sets whose tables go beyond ``CELLS`` take the joins.

``score_nested`` is the row-local form with higher-order functions: every rule
tried at every position, and weights added from left to right.

Tables: sequences (seq_id, sequence), rules (model_id, rule_idx, pattern,
weight).  A null or empty pattern never matches but stays a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUM, PRODUCT = 0, 1
BROADCAST_ROWS = 200_000


def check_mode(mode: int) -> None:
    if mode not in (SUM, PRODUCT):
        raise ValueError(f"mode must be {SUM} (sum) or {PRODUCT} (product), not {mode!r}")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has few enough rows to be broadcast; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def match_strings(rules: DataFrame) -> DataFrame:
    """(model_id, rule_idx, weight, gram): the strings that a rule matches; a palindrome counts once."""
    both = F.array_distinct(F.array("pattern", F.reverse("pattern")))
    usable = rules.where(F.col("pattern").isNotNull() & (F.length("pattern") > 0))
    return usable.select("model_id", "rule_idx", "weight", F.explode(both).alias("gram"))


def kgrams(
    sequences: DataFrame, lengths: DataFrame, carry: tuple[str, ...] = (), whole: bool = False, site: str | None = None, every: bool = False
) -> DataFrame:
    """(seq_id, *carry, pos, gram) for every position and each k of ``lengths`` (k) that fits there.

    ``lengths`` has a row for each distinct pattern length, so it is joined as a broadcast array: as wide as the
    longest pattern at most.  With ``whole`` every sequence, empty and null ones too, has the empty gram at position 0.
    With ``site``, a column, only the positions are taken whose grams may cover that one.  With ``every`` a position at
    which no gram fits has a null one.
    """
    ks = lengths.agg(F.sort_array(F.collect_set("k")).alias("ks"))
    text = F.coalesce("sequence", F.lit(""))
    s = sequences.select("seq_id", *carry, text.alias("_text"), *([F.col(site).alias("_site")] if site else [])).join(F.broadcast(ks))
    n = F.length("_text")
    from_ = F.lit(0 if whole else 1)
    if site:
        s = s.where("_site BETWEEN 1 AND length(_text)")
        places = F.sequence(F.greatest(F.lit(1), F.col("_site") - F.coalesce(F.array_max("ks"), F.lit(1)) + 1), F.col("_site"))
    else:
        places = F.sequence(from_, n)
    s = (s if whole else s.where(n > 0)).withColumn("pos", F.explode(places))
    fitting = F.filter("ks", lambda k: F.col("pos") + k - 1 <= n)
    s = s.withColumn("k", (F.explode_outer if every else F.explode)(F.when(F.col("pos") == 0, F.array(F.lit(0))).otherwise(fitting)))
    return s.select("seq_id", *carry, "pos", F.substring(F.col("_text"), F.col("pos"), F.col("k")).alias("gram"))


def _first_rules(sequences: DataFrame, rules: DataFrame, carry: tuple[str, ...] = (), models: DataFrame | None = None) -> DataFrame:
    """(model_id, seq_id, *carry, pos, rule_idx, weight, n_rules): the winning rule of each position that any rule matches.

    With ``models`` each model has a row of position 0, without a rule, for every sequence.
    """
    strings = match_strings(rules).drop("weight")
    if not is_small(rules):
        return _first_of_many(sequences, rules, strings, carry, models)
    lengths = strings.select(F.length("gram").alias("k")).distinct()
    if models is not None:
        none = models.select("model_id", F.lit(None).cast("int").alias("rule_idx"), F.lit("").alias("gram"))
        strings = strings.unionByName(none)
    weights = rules.select("model_id", "rule_idx", "weight")
    strings, weights = F.broadcast(strings), F.broadcast(weights)  # at most two strings for each rule and one for each model
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = kgrams(sequences.repartition(parts, "seq_id"), lengths, carry, models is not None)
    matched = grams.join(strings, "gram")
    # The least index is a hash aggregate; a struct with the weight would be sorted.
    won = matched.groupBy("model_id", "seq_id", *carry, "pos").agg(F.min("rule_idx").alias("rule_idx"), F.count("*").alias("n_rules"))
    won = won.join(weights, ["model_id", "rule_idx"], "inner" if models is None else "left")
    return won.select("model_id", "seq_id", *carry, "pos", "rule_idx", "weight", "n_rules")


#: Strings of one automaton, and sequences that it reads in one task.
AUTOMATON_STRINGS, AUTOMATON_SEQUENCES = 200_000, 20_000


def _scanner():
    """A function of its own, so that executors need not have this package."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        """The least rule of each model at each position of the sequences (left), of the strings (right), and how many match."""
        import ahocorasick

        models = [repr(m) if isinstance(m, dict) else m for m in right.column("model_id").to_pylist()]
        rule, of = right.column("rule_idx").to_pylist(), {}
        for k, gram in enumerate(right.column("gram").to_pylist()):
            of.setdefault(gram, []).append(k)
        machine = ahocorasick.Automaton()
        for gram, own in of.items():
            machine.add_word(gram, (len(gram), own))
        machine.make_automaton()
        rows: list[list[int]] = [[], [], [], []]
        for i, text in enumerate(left.column("sequence").to_pylist() if of else []):
            first: dict = {}
            for end, (n, own) in machine.iter(text):
                pos = end - n + 2
                for k in own:
                    at = (pos, models[k])
                    best = first.get(at)
                    if best is None:
                        first[at] = [k, 1]
                    else:
                        best[1] += 1
                        if rule[k] < rule[best[0]]:
                            best[0] = k
            for (pos, _), (k, n) in first.items():
                for out, v in zip(rows, (k, i, pos, n), strict=True):
                    out.append(v)
        which, who = pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())
        return pa.table({
            "model_id": right.column("model_id").take(which), "seq_id": left.column("seq_id").take(who), "pos": pa.array(rows[2], pa.int32()),
            "rule_idx": right.column("rule_idx").take(which), "n_rules": pa.array(rows[3], pa.int64()),
        })

    return scan


def _first_of_many(sequences: DataFrame, rules: DataFrame, strings: DataFrame, carry: tuple[str, ...], models: DataFrame | None) -> DataFrame:
    """The same for rules beyond ``BROADCAST_ROWS``, by automata that find all strings of a part of the rules in one pass.

    Sequences go to each part of the rules, and a part to each group of sequences; both are of bounded size.  So a letter is
    shuffled once for each part, not once for each gram that covers it.
    """
    parts = -(-strings.count() // AUTOMATON_STRINGS)
    groups = max(1, -(-sequences.count() // AUTOMATON_SEQUENCES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(max(n, 1))).cast("int")
    s = sequences.where(F.length("sequence") > 0).select("seq_id", "sequence", own(groups, "seq_id").alias("_group"), each(parts).alias("_part"))
    r = strings.withColumn("_part", own(parts, "gram", "model_id", "rule_idx")).withColumn("_group", each(groups))
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    schema = ", ".join((kind(rules, "model_id"), kind(sequences, "seq_id"), "pos int", kind(rules, "rule_idx"), "n_rules long"))
    keys = ["_group", "_part"]
    found = s.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_scanner(), schema)
    won = found.groupBy("model_id", "seq_id", "pos").agg(F.min("rule_idx").alias("rule_idx"), F.sum("n_rules").alias("n_rules"))
    won = won.join(rules.select("model_id", "rule_idx", "weight"), ["model_id", "rule_idx"])
    if carry:
        won = won.join(sequences.select("seq_id", *carry), "seq_id")
    won = won.select("model_id", "seq_id", *carry, "pos", "rule_idx", "weight", "n_rules")
    if models is None:
        return won
    few = models.select("model_id")
    every = sequences.select("seq_id", *carry).join(F.broadcast(few) if is_small(few) else few)  # every pair is asked for
    none = every.select("model_id", "seq_id", *carry, F.lit(0).alias("pos"), F.lit(None).cast("int").alias("rule_idx"), F.lit(None).cast("double").alias("weight"), F.lit(1).cast("long").alias("n_rules"))
    return won.unionByName(none)


#: Cells of a broadcast's tables (a trie's nodes times its models and letters), and of one trie's winners before prefixes are shared.
CELLS, TRIE_CELLS = 16_000_000, 1_000_000


def tries(rules: DataFrame) -> Broadcast | None:
    """The rules' strings as broadcast tries of a few models each, or None where the tables would be beyond ``CELLS``.

    A node's winner is, for each model, the least rule of the strings on the way to it: the first rule of a position whose
    letters lead there and no further.  Up to ``BROADCAST_ROWS`` rules are read, as many as a join would broadcast.
    """
    if not is_small(rules):
        return None
    rows = match_strings(rules).toArrow()
    ids = [repr(m) if isinstance(m, dict) else m for m in rows.column("model_id").to_pylist()]
    of: dict = {}
    for k, m in enumerate(ids):
        of.setdefault(m, []).append(k)
    rule, weight, grams = (rows.column(c).to_pylist() for c in ("rule_idx", "weight", "gram"))
    points = sorted({c for g in grams for c in g})
    letter, width = {c: k + 1 for k, c in enumerate(points)}, len(points) + 1
    parts, letters = [], 0
    for own in of.values():
        n = sum(len(grams[k]) for k in own)
        if not parts or (letters + n) * (len(parts[-1]) + 1) > TRIE_CELLS:
            parts.append([])
            letters = 0
        parts[-1].append(own)
        letters += n
    built, cells = [], 0
    for models in parts:
        parent, depth, child, ends = [0], [0], {}, []
        for m, own in enumerate(models):
            for k in own:
                at = 0
                for c in grams[k]:
                    key = at * width + letter[c]
                    if key not in child:
                        child[key] = len(parent)
                        parent.append(at)
                        depth.append(depth[at] + 1)
                    at = child[key]
                ends.append((rule[k], m, at, k))
        cells += len(parent) * (len(models) + width)
        if cells > CELLS:
            return None
        ends.sort(key=lambda e: e[0])
        least = np.full((len(models), len(parent)), len(ends), np.int32)  # a winner's place in the order of rules
        for place in range(len(ends) - 1, -1, -1):
            least[ends[place][1], ends[place][2]] = place
        of_node, level = np.array(parent), np.array(depth)
        for d in range(1, level.max() + 1):
            at = np.flatnonzero(level == d)
            least[:, at] = np.minimum(least[:, at], least[:, of_node[at]])
        step = np.zeros(len(parent) * width, np.int32)
        step[np.fromiter(child.keys(), np.int64, len(child))] = np.fromiter(child.values(), np.int32, len(child))
        weights = np.array([*[weight[e[3]] or 0.0 for e in ends], 0.0])[least]
        built.append((step, int(level.max()), weights, np.array([*[e[0] for e in ends], -1], np.int64)[least]))
    names = rows.column("model_id").combine_chunks().take(pa.array([own[0] for own in of.values()], pa.int64()))
    spec = {"points": np.array([ord(c) for c in points], np.uint32), "tries": built, "models": names}
    return rules.sparkSession.sparkContext.broadcast(spec)


def _walker():
    """Functions of their own, so that executors need not have this package: letters of texts, and where places end in a trie."""

    def read(texts: list, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all texts as numbers, 0 for those of no pattern, and the texts' lengths."""
        texts = [t or "" for t in texts]
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(t) for t in texts], np.int64)
        if not len(points):
            return np.zeros(len(code), np.int64), n
        at = np.minimum(np.searchsorted(points, code), len(points) - 1)
        return np.where(points[at] == code, at + 1, 0), n

    def walk(step: np.ndarray, depth: int, width: int, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last node that the letters from each start up to its end reach."""
        node, left = np.zeros(len(starts), np.int64), np.arange(len(starts))
        for k in range(depth):
            left = left[starts[left] + k < ends[left]]
            to = step[node[left] * width + letters[starts[left] + k]]
            left, to = left[to > 0], to[to > 0]
            node[left] = to
        return node

    return read, walk


def _model_sums(spec: Broadcast, words: int):
    """From batches (sequence or windows, fitness) to a task's sums of each model, as ``model_sums`` adds them up."""
    read, walk = _walker()

    def scan(batches):
        rules = spec.value
        width, models = len(rules["points"]) + 1, len(rules["models"])
        seen = [np.zeros(t[2].shape[1], bool) for t in rules["tries"]]
        total, low, high, rows = np.zeros((4, models)), np.full(models, np.inf), np.full(models, -np.inf), 0
        for b in batches:
            if not b.num_rows:
                continue
            given = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            f = b.column(1).fill_null(0.0).to_numpy(zero_copy_only=False)
            if pa.types.is_list(b.schema.types[0]):
                size = b.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                letters, n = read(b.column(0).flatten().to_pylist(), rules["points"])
                ends = np.cumsum(n)
                starts = ends - n
            else:
                letters, size = read(b.column(0).to_pylist(), rules["points"])
                starts, ends = np.arange(len(letters)), np.repeat(np.cumsum(size), size)
            full = np.flatnonzero(size)
            first, m = (np.cumsum(size) - size)[full], 0
            for (step, depth, weights, _), met in zip(rules["tries"], seen, strict=True):
                node = walk(step, depth, width, letters, starts, ends)
                met[node] = True
                x = np.zeros((len(weights), b.num_rows))
                if len(full):
                    for k, w in enumerate(weights):
                        x[k, full] = np.add.reduceat(w[node], first)
                at = slice(m, m := m + len(weights))
                own, fit = x[:, given], f[given]
                total[:, at] += [(own * own - 2 * own * fit).sum(1), x.sum(1), (x * x).sum(1), (own * fit).sum(1)]
                low[at], high[at] = np.fmin(low[at], np.fmin.reduce(x, 1)), np.maximum(high[at], x.max(1))
            rows += b.num_rows
        if not rows or not models:
            return
        won = []
        for (_, _, _, rule), met in zip(rules["tries"], seen, strict=True):
            for r in rule[:, met]:
                r = np.unique(r[r >= 0])
                bits = np.uint64(1) << (r % 64).astype(np.uint64)
                won.append([int(np.bitwise_or.reduce(bits[r // 64 == w], initial=np.uint64(0)).astype(np.int64)) for w in range(words)] if words else None)
        names = rules["models"]
        yield pa.RecordBatch.from_arrays(
            [names, pa.array([rows] * models, pa.int64()), *map(pa.array, total), pa.array(low), pa.array(high), pa.array(won, pa.list_(pa.int64()))],
            ["model_id", "hit", "d", "s", "ss", "sf", "low", "high", "won"],
        )

    return scan


def _place_sums(spec: Broadcast, name: str):
    """From batches (..., text, site) to (..., name), the sums; a site of 0 stands for all positions."""
    read, walk = _walker()

    def scan(batches):
        rules = spec.value
        width, longest = len(rules["points"]) + 1, max((t[1] for t in rules["tries"]), default=1)
        weights = [t[2].sum(0) for t in rules["tries"]]
        for b in batches:
            letters, n = read(b.column(b.num_columns - 2).to_pylist(), rules["points"])
            site = b.column(b.num_columns - 1).fill_null(-1).to_numpy(zero_copy_only=False)
            asked = (site == 0) | (site >= 1) & (site <= n)
            first = np.where(site == 0, 0, np.maximum(site - longest, 0))
            size = np.where(asked, np.where(site == 0, n, site) - first, 0)
            offsets = np.concatenate([[0], np.cumsum(size)])
            end = np.cumsum(n)
            starts = np.arange(offsets[-1]) + np.repeat(end - n + first - offsets[:-1], size)
            ends, sums = np.repeat(end, size), np.zeros(offsets[-1])
            for (step, depth, _, _), w in zip(rules["tries"], weights, strict=True):
                sums += w[walk(step, depth, width, letters, starts, ends)]
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums), mask=pa.array(~asked))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], out], [*b.schema.names[:-2], name])

    return scan


def hits(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, seq_id, pos, rule_idx, weight, n_rules): the winning rule of each position that any rule matches."""
    return _first_rules(sequences, rules)


def position_sums(sequences: DataFrame, rules: DataFrame, site: str | None = None) -> DataFrame:
    """(seq_id, sums): the winning weights of all models together, for each position of a sequence in order.

    With ``site``, a column of ``sequences``, only for the positions whose first rules depend on that letter: from the
    longest pattern before it up to the site itself.  An empty sequence has no row.
    """
    spec = tries(rules)
    if spec is None:
        return _joined_position_sums(sequences, rules, site)
    d = sequences.where(F.length("sequence") > 0).select("seq_id", "sequence", *([site] if site else []))
    return with_position_sums(d, spec, "sequence", site).where("sums IS NOT NULL").select("seq_id", "sums")


def with_position_sums(rows: DataFrame, spec: Broadcast, text: str, site: str | None = None, name: str = "sums") -> DataFrame:
    """The rows with a column ``name``, the sums of ``position_sums`` for their ``text``, row by row; null where the site isn't in the text."""
    at = F.col(site).cast("long") if site else F.lit(0).cast("long")
    at = F.when(at >= 1, at) if site else at
    given = rows.select("*", F.col(text).alias("_text"), at.alias("_site"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{name} array<double>"])
    return given.mapInArrow(_place_sums(spec, name), schema)


def _joined_position_sums(sequences: DataFrame, rules: DataFrame, site: str | None) -> DataFrame:
    """The same by joins, for rules of any number."""
    strings, weights = match_strings(rules).drop("weight"), rules.select("model_id", "rule_idx", "weight")
    lengths = strings.select(F.length("gram").alias("k")).distinct()
    if is_small(rules):
        strings, weights = F.broadcast(strings), F.broadcast(weights)
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = kgrams(sequences.repartition(parts, "seq_id"), lengths, site=site, every=True)
    won = grams.join(strings, "gram", "left").groupBy("seq_id", "pos", "model_id").agg(F.min("rule_idx").alias("rule_idx"))
    at = won.join(weights, ["model_id", "rule_idx"], "left").groupBy("seq_id", "pos").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"))
    placed = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return at.groupBy("seq_id").agg(F.transform(placed, lambda x: x["s"]).alias("sums"))


def score(
    sequences: DataFrame, rules: DataFrame, models: DataFrame | None = None, mode: int = SUM, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(model_id, seq_id, score, hits, *carry) for every model and sequence, also those without a hit.

    ``carry`` names columns of ``sequences``, one value for each seq_id.  The product mode multiplies weights onto 0
    and so is 0; ``products`` has the corrected form.
    """
    check_mode(mode)
    models = rules.select("model_id").distinct() if models is None else models.select("model_id")
    per = _first_rules(sequences, rules, carry, models).groupBy("model_id", "seq_id", *carry)
    per = per.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"), F.count("rule_idx").alias("hits"))
    value = F.col("s") if mode == SUM else F.lit(0.0)
    return per.select("model_id", "seq_id", value.alias("score"), "hits", *carry)


def predictions(sequences: DataFrame, rules: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(model_id, seq_id, score, fitness, error, *carry) of sequences with their fitness, without a join back to them."""
    p = score(sequences, rules, carry=("fitness", *carry))
    return p.select("model_id", "seq_id", "score", "fitness", F.abs(F.col("score") - F.col("fitness")).alias("error"), *carry)


def products(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, seq_id, product): the product of the winning weights of each pair that has a hit."""
    return hits(sequences, rules).groupBy("model_id", "seq_id").agg(F.product("weight").alias("product"))


def nested(rules: DataFrame) -> DataFrame:
    """(model_id, rules): each model's rules as an array in stored order."""
    r = F.array_sort(F.collect_list(F.struct("rule_idx", "pattern", "weight")))
    return rules.groupBy("model_id").agg(r.alias("rules"))


def flat(models: DataFrame) -> DataFrame:
    """(model_id, rule_idx, pattern, weight), the reverse of ``nested``."""
    return models.select("model_id", F.explode("rules").alias("r")).select("model_id", "r.*")


def score_nested(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, seq_id, score) row by row, without a shuffle of the sequences; for few rules or exact order of addition.

    Every rule is tried at every position.  Up to ``BROADCAST_ROWS`` rules all models go to all sequences; beyond, each
    model meets the sequences by a shuffle, a row for each model.
    """
    m = nested(rules).withColumn(
        "rules",
        F.transform("rules", lambda r: F.struct(
            r["pattern"].alias("p"), F.reverse(r["pattern"]).alias("q"), F.length(r["pattern"]).alias("n"), r["weight"].alias("w")
        )),
    )

    def at(pos: Column) -> Column:
        piece = lambda r: F.substring(F.col("sequence"), pos, r["n"])
        fits = lambda r: (r["n"] > 0) & (pos + r["n"] - 1 <= F.length("sequence"))
        first = F.filter("rules", lambda r: fits(r) & ((piece(r) == r["p"]) | (piece(r) == r["q"])))
        return F.coalesce(F.try_element_at(first, F.lit(1))["w"], F.lit(0.0))

    positions = F.when(F.length("sequence") > 0, F.sequence(F.lit(1), F.length("sequence"))).otherwise(
        F.array().cast("array<int>")
    )
    total = F.aggregate(positions, F.lit(0.0), lambda acc, pos: acc + at(pos))
    pairs = sequences.join(F.broadcast(m) if is_small(rules) else m)
    return pairs.select("model_id", "seq_id", F.coalesce(total, F.lit(0.0)).alias("score"))


def absolute_error(scores: DataFrame, actual: DataFrame) -> DataFrame:
    """(model_id, seq_id, score, fitness, error) for scores and actual (seq_id, fitness)."""
    return scores.join(actual.select("seq_id", "fitness"), "seq_id").select(
        "model_id", "seq_id", "score", "fitness", F.abs(F.col("score") - F.col("fitness")).alias("error")
    )


def rule_status(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``status``: 1 if the rule won a position of any sequence, else 0.

    Statuses are derived anew on each evaluation, so there is nothing to reset.
    """
    won = hits(sequences, rules).select("model_id", "rule_idx").distinct().withColumn("_won", F.lit(1))
    kept = [c for c in rules.columns if c != "status"]
    return rules.join(won, ["model_id", "rule_idx"], "left").select(*kept, F.coalesce("_won", F.lit(0)).alias("status"))


def used_rule_count(status: DataFrame) -> DataFrame:
    """(model_id, rule_count, used_rule_count)."""
    return status.groupBy("model_id").agg(
        F.count("*").alias("rule_count"), F.sum(F.col("status").cast("long")).alias("used_rule_count")
    )


def drop_unused(status: DataFrame) -> DataFrame:
    """Rules whose status isn't 0."""
    return status.where(F.col("status") != 0)


#: Rule numbers that a bitmap's word holds.
WORD = 64
#: Rules of larger models aren't noted in bitmaps.
MOST_WORDS = 64


def bitmap_words(rules: DataFrame) -> int:
    """How many words the bitmap of a model's rules has; 0 where there would be more than ``MOST_WORDS``."""
    top = rules.agg(F.max("rule_idx")).first()[0]
    words = 1 if top is None else top // WORD + 1
    return words if words <= MOST_WORDS else 0


def _joined_sums(sequences: DataFrame, rules: DataFrame, index: GramIndex | None, words: int) -> DataFrame:
    """(model_id, hit, d, s, ss, sf, low, high, won) of the sequences with a hit, of which there are ``hit``; hits are rows."""
    won = _first_rules(sequences, rules, ("fitness",)) if index is None else index.first_rules(rules)
    bits = [F.when(F.floor(F.col("rule_idx") / WORD) == w, F.expr(f"shiftleft(1L, rule_idx - {w * WORD})")).otherwise(F.lit(0)) for w in range(words)]
    f = F.col("fitness")
    per = won.groupBy("model_id", "seq_id", "fitness").agg(F.sum("weight").alias("x"), *[F.bit_or(b).alias(f"w{w}") for w, b in enumerate(bits)])
    x = F.col("x")
    return per.groupBy("model_id").agg(
        F.count("*").alias("hit"), F.sum(F.pow(x - f, 2) - f * f).alias("d"), F.sum("x").alias("s"), F.sum(x * x).alias("ss"), F.sum(x * f).alias("sf"),
        F.min("x").alias("low"), F.max("x").alias("high"),
        (F.array(*[F.bit_or(f"w{w}") for w in range(words)]) if words else F.lit(None).cast("array<long>")).alias("won"),
    )


def deal(sequences: DataFrame) -> DataFrame:
    """The sequences dealt out by their id to a few tasks for each core.

    A scan by ``tries`` holds one batch of rows at a time, so that its tasks need not be as small as those of a shuffle that
    sorts or aggregates; each has its own start of Python and its own row for each model.
    """
    spark = sequences.sparkSession
    return sequences.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "seq_id")


def _scanned_sums(sequences: DataFrame, rules: DataFrame, spec: Broadcast, index: GramIndex | None, words: int, dealt: bool) -> DataFrame:
    """The same of all sequences, by ``tries``; a task has one row for each model."""
    if index is None:
        rows = (sequences if dealt else deal(sequences)).select("sequence", F.col("fitness").cast("double").alias("fitness"))
    else:
        rows = index.spark.table(index.name).select("windows", F.col("fitness").cast("double").alias("fitness"))
    kind = rules.schema["model_id"].dataType.simpleString()
    sums = ("d", "s", "ss", "sf")
    schema = f"model_id {kind}, hit long, {', '.join(f'{c} double' for c in (*sums, 'low', 'high'))}, won array<long>"
    won = F.array(*[F.bit_or(F.get("won", F.lit(w))) for w in range(words)]) if words else F.lit(None).cast("array<long>")
    return rows.mapInArrow(_model_sums(spec, words), schema).groupBy("model_id").agg(
        F.sum("hit").alias("hit"), *[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"), won.alias("won")
    )


def model_sums(
    sequences: DataFrame, rules: DataFrame, models: DataFrame | None = None, index: GramIndex | None = None, words: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """(model_id, n, sse, s, ss, sf, f, ff, low, high, won): what a model's metrics need, in one pass over the hits.

    Tasks add up the sums of their sequences by ``tries``; rules too many for these are joined, hit by hit.
    ``s`` and ``ss`` sum the scores and their squares, ``sf`` scores times fitness, ``f`` and ``ff`` fitness, ``low`` and
    ``high`` are the least and greatest score, all over every sequence (seq_id, sequence, fitness); ``won`` is a bitmap of
    the rules that won a position, as ``words`` words of 64 bits (null for 0).  A sequence without a hit scores 0 for every model, so the pairs of
    models and sequences are never made.  With ``index`` the sequences' grams are read from it;
    ``dealt`` sequences are scanned as they lie, those of ``deal`` for one.
    """
    models = rules.select("model_id").distinct() if models is None else models.select("model_id")
    words = bitmap_words(rules) if words is None else words
    spec = tries(rules)
    g = _joined_sums(sequences, rules, index, words) if spec is None else _scanned_sums(sequences, rules, spec, index, words, dealt)
    f = F.col("fitness")
    every = index.totals if index else sequences.agg(F.count("*").alias("n"), F.sum("fitness").alias("f"), F.sum(f * f).alias("ff"))
    out = models.join(g, "model_id", "left").join(F.broadcast(every))  # one row
    zero, missed = F.lit(0.0), F.coalesce("hit", F.lit(0)) < F.col("n")
    none = F.array(*[F.lit(0).cast("long")] * words) if words else F.lit(None).cast("array<long>")
    return out.select(
        "model_id", "n", (F.coalesce("ff", zero) + F.coalesce("d", zero)).alias("sse"), *[F.coalesce(c, zero).alias(c) for c in ("s", "ss", "sf", "f", "ff")],
        F.when(missed, F.least("low", zero)).otherwise(F.col("low")).alias("low"), F.when(missed, F.greatest("high", zero)).otherwise(F.col("high")).alias("high"),
        F.coalesce("won", none).alias("won"),
    )


def has_won(won: Column, rule_idx: Column) -> Column:
    """1 if the rule is in a bitmap of ``model_sums``, else 0."""
    word = F.get(won, F.floor(rule_idx / WORD).cast("int"))
    return F.call_function("getbit", word, F.pmod(rule_idx, F.lit(WORD)).cast("int")).cast("int")


@dataclass(frozen=True)
class GramIndex:
    """A learn set's k-grams, written once and read by every generation: a bucketed table (seq_id, fitness, windows).

    ``windows`` has the longest gram of each position, whose beginnings are the shorter ones.  The buckets are those of
    ``seq_id``, so that neither the join with broadcast rules nor a position's first rule nor a sequence's sum has an
    exchange.  Rules beyond ``BROADCAST_ROWS`` are joined by shuffle.
    """

    spark: SparkSession
    name: str
    longest: int
    totals: DataFrame

    @classmethod
    def write(cls, sequences: DataFrame, name: str, longest: int, buckets: int, path: str | None = None) -> GramIndex:
        """Of sequences (seq_id, sequence, fitness), for patterns of up to ``longest`` letters."""
        spark = sequences.sparkSession
        places = F.when(F.length("sequence") > 0, F.sequence(F.lit(1), F.length("sequence"))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(places, lambda p: F.substring(F.col("sequence"), p, F.lit(longest)))
        rows = sequences.repartition(buckets, "seq_id").select("seq_id", "fitness", windows.alias("windows"))
        out = rows.write.mode("overwrite").bucketBy(buckets, "seq_id").sortBy("seq_id")
        (out.option("path", path) if path else out).saveAsTable(name)
        f = F.col("fitness")
        every = spark.table(name).agg(F.count("*").alias("n"), F.sum("fitness").alias("f"), F.sum(f * f).alias("ff")).first()
        return cls(spark, name, longest, spark.createDataFrame([tuple(every)], "n long, f double, ff double"))

    def first_rules(self, rules: DataFrame) -> DataFrame:
        """(model_id, seq_id, fitness, pos, rule_idx, weight), as ``hits`` has them."""
        strings, weights = match_strings(rules).drop("weight"), rules.select("model_id", "rule_idx", "weight")
        ks = strings.select(F.length("gram").alias("k")).agg(F.sort_array(F.collect_set("k")).alias("ks"))  # as wide as the longest pattern
        if is_small(rules):
            strings, weights = F.broadcast(strings), F.broadcast(weights)
        at = self.spark.table(self.name).select("seq_id", "fitness", F.posexplode("windows").alias("pos", "window")).join(F.broadcast(ks))
        beginnings = F.transform(F.filter("ks", lambda k: k <= F.length("window")), lambda k: F.substring(F.col("window"), F.lit(1), k))
        met = at.select("seq_id", "fitness", (F.col("pos") + 1).alias("pos"), F.explode(beginnings).alias("gram")).join(strings, "gram")
        won = met.groupBy("model_id", "seq_id", "fitness", "pos").agg(F.min("rule_idx").alias("rule_idx"))
        return won.join(weights, ["model_id", "rule_idx"]).select("model_id", "seq_id", "fitness", "pos", "rule_idx", "weight")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def squared_errors(sequences: DataFrame, rules: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(model_id, n, sse) over all sequences (seq_id, sequence, fitness); for models of any number of rules.

    A sequence without a hit adds fitness² for every model, so the pairs of models and sequences are never made.
    """
    return model_sums(sequences, rules, models, words=0).select("model_id", "n", "sse")


def totals(sequences: DataFrame, rules: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, *carry, total): the sum over all models' scores, 0 without a hit."""
    no_model = F.lit(None).cast(rules.schema["model_id"].dataType).alias("model_id")
    all_models = rules.sparkSession.range(1).select(no_model)
    per = _first_rules(sequences, rules, carry, all_models).groupBy("seq_id", *carry)
    return per.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))


def first_by_sequence(predictions: DataFrame) -> DataFrame:
    """The first row (by row_idx) of each sequence, for lookups of actual values by sequence."""
    cols = [c for c in predictions.columns if c != "sequence"]
    first = F.min_by(F.struct(*cols), "row_idx").alias("r")
    return predictions.groupBy("sequence").agg(first).select("sequence", "r.*").select(*predictions.columns)
