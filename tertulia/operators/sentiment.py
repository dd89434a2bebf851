"""Lexicon sentiment, word transitions and pattern polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..functions.reuse import once_per_application
from ..rules import lexicon as L
from ..session import materialize


def _fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A rule table of at most some hundred fixed rows, broadcast to its joins."""
    return F.broadcast(spark.createDataFrame(rows, schema))


WORDS_PER_PART = 200_000
PARTS_PER_TASK = 32
SUMMED_WORDS = 1 << 18  # words whose vectors a task holds in sums


def lexicon_table(spark, words: dict[str, float] | None = None) -> DataFrame:
    return _fixed_table(spark, list((words or L.LEXICON).items()), "word string, score double")


def modifiers() -> dict[str, float]:
    """Factor of each single word that can stand before another: negation times intensity."""
    single = {w: -1.0 for w in L.NEGATORS if " " not in w}
    for w, m in L.INTENSIFIERS.items():
        if " " not in w:
            single[w] = single.get(w, 1.0) * m
    return single


def token_steps(words: Column) -> Column:
    """Words paired with the word before them."""
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(words, i - 1)).alias("before")))


def _sql_map(table: dict[str, float]) -> str:
    quoted = lambda w: "'" + w.replace("'", "\\'") + "'"
    return "map(" + ", ".join(f"{quoted(w)}, {v!r}D" for w, v in table.items()) + ")"


@once_per_application
def _word_values(words: str) -> tuple[Column, Column]:
    """Sum of the scores of a column of words, each under the word before it, and how many words have one.

    Works inside the row: words without a score leave by a set test, and only
    the others look up their score and factor.
    """
    factors = modifiers()
    hits = F.filter(token_steps(F.col(words)), lambda t: t["word"].isin(list(L.LEXICON)))
    score, factor = F.expr(_sql_map(L.LEXICON)), F.expr(_sql_map(factors))
    value = lambda t: F.element_at(score, t["word"]) * F.coalesce(F.when(t["before"].isin(list(factors)), F.element_at(factor, t["before"])), F.lit(1.0))
    total = F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + value(t))
    return F.coalesce(total, F.lit(0.0)), F.coalesce(F.size(hits), F.lit(0)).cast("long")


def lexicon_scores(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sum of word scores per message, each under the word before it.  Narrow: a message is scored in its row."""
    score, hits = _word_values("_w")
    return messages.select(*keys, X.words(F.col(text)).alias("_w")).select(*keys, score.alias("score"), hits.alias("hits"))


def dead_band_label(score: Column | str, band: float = 0.1) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > band, "positivo").when(s < -band, "negativo").otherwise("neutro")


def sign_label(score: Column | str) -> Column:
    return dead_band_label(score, 0.0)


def sign_value(score: Column | str, neutral: bool = True) -> Column:
    """Score to -1/0/1, or to 0/1 when there is no neutral class."""
    s = F.col(score) if isinstance(score, str) else score
    if neutral:
        return F.when(s > 0, 1).when(s < 0, -1).otherwise(0).cast("long")
    return F.when(s > 0, 1).otherwise(0).cast("long")


def sentences(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def adversative_weight(sentence: Column) -> Column:
    """Weight of the first contrast word found in the sentence, by list order; 1 without one."""
    low = F.lower(sentence)
    w = None
    for word, weight in L.ADVERSATIVES.items():
        hit = F.contains(low, F.lit(word))
        w = F.when(hit, weight) if w is None else w.when(hit, weight)
    return w.otherwise(1.0)


def phrase_adjustment(sentence: Column) -> Column:
    """Sum of the phrase rules found in a sentence."""
    low = F.lower(sentence)
    total = F.lit(0.0)
    for _, regex, delta in L.PHRASES:
        total = total + F.regexp_count(low, F.lit("(?U)" + regex)).cast("double") * F.lit(delta)
    return total


def sentence_rows(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return messages.select(*keys, F.posexplode_outer(sentences(text)).alias("sentence_no", "sentence"))


def sentence_scores(messages: DataFrame, keys: list[str], text: str = "text", phrases: bool = False) -> DataFrame:
    """Score of each sentence under its contrast weight, with phrase rules on request."""
    s = sentence_rows(messages, keys, text).withColumn("weight", adversative_weight(F.col("sentence")))
    if phrases:
        s = s.withColumn("extra", phrase_adjustment(F.col("sentence")))
    keep = [*keys, "sentence_no", "weight"] + (["extra"] if phrases else [])
    t = s.select(*keep, X.words(F.col("sentence")).alias("_w")).select(*keep, _word_values("_w")[0].alias("plain"))
    base = F.col("plain") + F.col("extra") if phrases else F.col("plain")
    return t.select(*keys, "sentence_no", (base * F.coalesce("weight", F.lit(1.0))).alias("score"))


def text_scores(messages: DataFrame, keys: list[str], text: str = "text", phrases: bool = True) -> DataFrame:
    """Total of the sentence scores per message."""
    return sentence_scores(messages, keys, text, phrases).groupBy(*keys).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


def fallback_score(word: Column | str) -> Column:
    """Score of a word outside the lexicon: fixed words, then suffix rules, else 0."""
    w = F.lower(F.col(word) if isinstance(word, str) else word)
    by_score: dict[float, list[str]] = {}
    for k, v in L.FALLBACK_WORDS.items():
        by_score.setdefault(v, []).append(k)
    out = None
    for v, ks in by_score.items():
        out = F.when(w.isin(ks), v) if out is None else out.when(w.isin(ks), v)
    for regex, v in L.FALLBACK_SUFFIXES:
        out = out.when(F.regexp_like(w, F.lit(regex)), v)
    return out.otherwise(0.0)


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, average score, label shares and the most common label, overall or per group.

    Scores are summed as decimals, so the average does not depend on the order of rows.
    """
    by = by or []
    n = F.count("*")
    labels = ["positivo", "negativo", "neutro"]
    counts = {lab: F.count_if(F.col("label") == lab) for lab in labels}
    g = scored.groupBy(*by).agg(
        n.alias("total_messages"), F.round(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / n, 2).alias("average_score"), *[c.alias(k) for k, c in counts.items()])
    pct = [F.round(F.col(k) * 100.0 / F.col("total_messages"), 2).alias(k + "_pct") for k in labels]
    best = F.greatest(*labels)
    common = (F.when(F.col("negativo") == best, "negativo").when(F.col("neutro") == best, "neutro").otherwise("positivo"))
    return g.select(*by, "total_messages", "average_score", *labels, *pct, common.alias("most_common_sentiment"))


def chat_sentiment(messages: DataFrame, scorer=lexicon_scores) -> DataFrame:
    """Scored non-blank messages with label and sender (missing sender: Unknown)."""
    m = messages.filter(F.trim("text") != "").withColumn("sender", F.coalesce("sender_name", F.lit("Unknown")))
    s = scorer(m, ["chat_id", "id", "sender"])
    return s.withColumn("label", dead_band_label("score"))


def clean_tokens(text: Column | str, stem: bool = False) -> Column:
    """Lower-case words of three letters or more, no digits, no function words."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    t = F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "), r"[0-9]+", "")
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(X.STOP_WORDS))
    if stem:
        words = F.transform(words, lambda w: F.regexp_replace(w, r"(amente|mente|ciones|ción|adores|ador|ando|iendo|ados|adas|ado|ada|idos|idas|ido|ida|os|as|es|o|a|e)$", ""))
    return words


def vocabulary(tokens: DataFrame, min_count: int = 2, column: str = "tokens") -> DataFrame:
    return tokens.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def bigrams(tokens: Column | str) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda w, i: F.struct(w.alias("cur"), F.get(t, i + 1).alias("nxt")))


def transitions(tokens: DataFrame, min_count: int = 2) -> DataFrame:
    """P(next word | word, label) over in-vocabulary neighbours.

    Pairs are counted first, so the vocabulary joins see each pair once
    instead of every occurrence of a frequent word.
    """
    vocab = vocabulary(tokens, min_count).select("token")
    pairs = tokens.select("label", F.explode(bigrams("tokens")).alias("b")).groupBy("label", "b.cur", "b.nxt").agg(F.count("*").alias("n"))
    known = materialize(pairs.join(vocab.withColumnRenamed("token", "cur"), "cur", "left_semi").join(
        vocab.withColumnRenamed("token", "nxt"), "nxt", "left_semi"), "word_pairs")
    totals = known.groupBy("label", "cur").agg(F.sum("n").alias("total"))
    return known.join(totals, ["label", "cur"]).select("label", "cur", "nxt", (F.col("n") / F.col("total")).alias("p"))


def sequence_scores(tokens: DataFrame, trans: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each label in the summed transition probabilities; even without any hit."""
    wide = trans.groupBy("cur", "nxt").agg(
        F.sum(F.when(F.col("label") == 0, F.col("p")).otherwise(0.0)).alias("p0"),
        F.sum(F.when(F.col("label") == 1, F.col("p")).otherwise(0.0)).alias("p1"))
    steps = tokens.select(*keys, F.explode_outer(bigrams("tokens")).alias("b")).groupBy(*keys, "b.cur", "b.nxt").agg(F.count("*").alias("n"))
    s = steps.join(wide, ["cur", "nxt"], "left").groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("p0") * F.col("n")), F.lit(0.0)).alias("s0"), F.coalesce(F.sum(F.col("p1") * F.col("n")), F.lit(0.0)).alias("s1"))
    total = F.col("s0") + F.col("s1")
    even = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.5)
    return s.select(*keys, even("s0").alias("p0"), even("s1").alias("p1"))


def sequence_label(scores: DataFrame) -> DataFrame:
    return scores.withColumn("prediction", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0).cast("long"))


NEGATIVES = 10
POSITIONS = DRAWN = 128
MOST_STEPS = 4


def _start_vectors(words: list[str], size: int, seed: int):
    """Small first vectors, the same for a word in whichever part it stands."""
    from hashlib import blake2b

    import numpy as np

    h = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in words], dtype=np.uint64)
    z = h[:, None] + np.arange(1, size + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5) / size).astype(np.float32)


def _add_rows(table, at, rows) -> None:
    """table[at] += rows, where a place may come several times; more than MOST_STEPS of one step count as that many."""
    import numpy as np

    order = np.argsort(at, kind="stable")
    place, first, times = np.unique(at[order], return_index=True, return_counts=True)
    table[place] += np.add.reduceat(rows[order], first, axis=0) * np.minimum(1, MOST_STEPS / times).astype(np.float32)[:, None]


def _skip_grams(texts: list, vectors, out, window: int, rng, rate: float, least: float) -> None:
    """One pass of skip-grams with negative samples over texts of word numbers; changes ``vectors`` and ``out``.

    `POSITIONS` positions are one step.  They share DRAWN negatives, each weighted
    so that a pair has as much of them as of NEGATIVES of its own; a word is no
    negative of itself.
    """
    import numpy as np

    flat = np.concatenate(texts)
    n, text = len(flat), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    share = np.bincount(flat, minlength=len(vectors)) ** 0.75
    bounds = np.cumsum(share / share.sum())
    sure = lambda s: (1.0 / (1.0 + np.exp(-np.clip(s, -8, 8)))).astype(np.float32)
    for begin in range(0, n, POSITIONS):
        end = min(begin + POSITIONS, n)
        low, high = max(begin - window, 0), min(end + window, n)
        pace = np.float32(least + (rate - least) * (1 - begin / n))
        near, mid = flat[low:high], flat[begin:end]
        drawn = np.minimum(np.searchsorted(bounds, rng.random(DRAWN)), len(vectors) - 1)
        x, o, y = vectors[near], out[mid], out[drawn]
        dx, do, met = np.zeros_like(x), np.zeros_like(o), np.zeros((len(near), DRAWN), np.float32)
        other = (mid[:, None] != drawn).astype(np.float32)
        reach = rng.integers(1, window + 1, end - begin)
        for k in [*range(-window, 0), *range(1, window + 1)]:
            first, last = max(begin + k, 0), min(end + k, n)
            if first >= last:
                continue
            at, of = slice(first - low, last - low), slice(first - k - begin, last - k - begin)
            inside = ((reach[of] >= abs(k)) & (text[first:last] == text[first - k:last - k])).astype(np.float32)
            g = ((1 - sure(np.einsum("ij,ij->i", x[at], o[of]))) * inside * pace)[:, None]
            dx[at] += g * o[of]
            do[of] += g * x[at]
            met[at] += inside[:, None] * other[of]
        g = -sure(x @ y.T) * met * (pace * np.float32(NEGATIVES / DRAWN))
        dx += g @ y
        _add_rows(vectors, near, dx)
        _add_rows(out, np.concatenate([mid, drawn]), np.concatenate([do, g.T @ x]))


def _scarce_places(rows: DataFrame, min_count: int) -> DataFrame:
    """_part, token of the words that stand less than `min_count` times in all texts (_part, tokens).

    A batch of texts is counted before anything is shuffled: a word gives one row, and one for
    each place only where the batch has fewer than `min_count` of it.
    """
    import numpy as np
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            code, parts = coded.indices.to_numpy(zero_copy_only=False), np.repeat(batch.column("_part").to_numpy(), lists.value_lengths().to_numpy())
            n = np.bincount(code, minlength=len(coded.dictionary))
            few, many = np.flatnonzero(n[code] < min_count), np.flatnonzero(n >= min_count)
            words = coded.dictionary.take(pa.array(np.concatenate([code[few], many])))
            places = pa.array(np.concatenate([parts[few], np.zeros(len(many), np.int32)]), pa.int32(), mask=np.arange(len(few) + len(many)) >= len(few))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([np.ones(len(few), np.int64), n[many]])), places], names=["token", "n", "_part"])

    seen = rows.select("_part", "tokens").mapInArrow(counted, "token string, n long, _part int")
    total = seen.withColumn("_all", F.sum("n").over(W.partitionBy("token")))
    return total.filter((F.col("_all") < min_count) & F.col("_part").isNotNull()).select("_part", "token").distinct()


class _Sums:
    """Sums of vectors by word, of at most `SUMMED_WORDS` words, in a nameless file; batches (word, n, numbers) come out as it gets full."""

    def __init__(self, width: int):
        import tempfile

        import numpy as np

        self.file = tempfile.TemporaryFile()
        self.at, self.n, self.sums = {}, np.zeros(SUMMED_WORDS, np.int64), np.memmap(self.file, np.float32, "w+", shape=(SUMMED_WORDS, width))

    def add(self, words: list[str], rows):
        import numpy as np

        for a in range(0, len(words), SUMMED_WORDS):
            some = words[a:a + SUMMED_WORDS]
            if len(self.at) + sum(w not in self.at for w in some) > SUMMED_WORDS:
                yield from self.out()
            begun = len(self.at)
            at = np.array([self.at.setdefault(w, len(self.at)) for w in some], np.int64)
            own, old = rows[a:a + SUMMED_WORDS], at < begun
            self.sums[at[~old]], self.n[at[~old]] = own[~old], 1
            self.sums[at[old]] += own[old]
            self.n[at[old]] += 1

    def out(self):
        words = list(self.at)
        for a in range(0, len(words), 4096):
            some = slice(a, min(a + 4096, len(words)))
            yield _vector_batch(words[some], self.n[some], self.sums[some])
        self.at = {}


def _vector_batch(words, n, rows):
    import numpy as np
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(rows, np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * rows.shape[1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), lists], names=["word", "n", "numbers"])


def _averaged(batches):
    """Of sums sorted by word the average of each word, which may reach over several batches."""
    import numpy as np

    word, times, total = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        words = np.array(batch.column("word").to_pylist(), dtype=object)
        rows = batch.column("numbers").flatten().to_numpy().reshape(len(words), -1).astype(np.float64)
        first = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1])
        names, n, sums = words[first], np.add.reduceat(batch.column("n").to_numpy(), first), np.add.reduceat(rows, first, axis=0)
        if word == names[0]:
            n[0], sums[0] = n[0] + times, sums[0] + total
        elif word is not None:
            yield _vector_batch([word], [times], total[None] / times)
        if len(names) > 1:
            yield _vector_batch(list(names[:-1]), n[:-1], sums[:-1] / n[:-1, None])
        word, times, total = names[-1], n[-1], sums[-1]
    if word is not None:
        yield _vector_batch([word], [times], total[None] / times)


def word_vectors(tokens: DataFrame, size: int = 100, window: int = 5, min_count: int = 2, seed: int = 42, iterations: int = 1) -> DataFrame:
    """Skip-gram word vectors with negative samples: word, vector as a float array.

    The corpus is trained in parts of about WORDS_PER_PART words side by side,
    whose vectors are averaged after each iteration.  A task trains its parts one
    after another, each on the vectors of its own words only, and sums what they
    give before it hands it on; the whole vocabulary lies in tables and is nowhere
    gathered.
    """
    rows = materialize(tokens.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("_row"), "tokens"), "vector_texts")
    words = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-words // WORDS_PER_PART))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, cores * -(-parts // (cores * PARTS_PER_TASK)))
    texts = rows.select(F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int").alias("_part"), "_row", "tokens")
    lost = _scarce_places(texts, min_count)
    if iterations > 1:
        lost = materialize(lost, "scarce_words")

    def fit(turn):
        """Trains a part in iteration ``turn``, with what is known of its words; words and their numbers."""
        def run(part, rows):
            import numpy as np

            away = set(rows["lost"])
            kept = [[w for w in t if w not in away] for _, t in sorted(zip(rows["_row"], rows["tokens"]), key=lambda r: r[0])]
            names, number = np.unique(np.array([w for t in kept for w in t], dtype=object), return_inverse=True)
            if not len(names):
                return [], None
            vectors, out = _start_vectors(list(names), size, seed), np.zeros((len(names), size), np.float32)
            if rows["word"]:
                at, known = np.searchsorted(names, np.array(rows["word"], dtype=object)), np.concatenate(rows["numbers"]).reshape(-1, 2, size)
                vectors[at], out[at] = known[:, 0], known[:, 1]
            cuts = np.cumsum([len(t) for t in kept])[:-1]
            rate = [0.025 * max(1e-4, 1 - i / iterations) for i in (turn, turn + 1)]
            _skip_grams(np.split(number.ravel(), cuts), vectors, out, window, np.random.default_rng([seed, turn, part]), *rate)
            return list(names), vectors if turn + 1 == iterations else np.concatenate([vectors, out], axis=1)

        def all_parts(batches):
            import numpy as np

            sums, part, held = _Sums(size if turn + 1 == iterations else 2 * size), None, None
            for batch in batches:
                of = batch.column("_part").to_numpy()
                bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                for a, b in zip(bounds, bounds[1:]):
                    if a == b:
                        continue
                    if of[a] != part:
                        if held:
                            yield from sums.add(*run(part, held))
                        part, held = int(of[a]), {"_row": [], "tokens": [], "lost": [], "word": [], "numbers": []}
                    own = batch.slice(a, b - a)
                    texts = own.filter(own.column("tokens").is_valid())
                    held["_row"] += texts.column("_row").to_pylist()
                    held["tokens"] += texts.column("tokens").to_pylist()
                    held["lost"] += own.column("lost").drop_null().to_pylist()
                    known = own.filter(own.column("word").is_valid())
                    held["word"] += known.column("word").to_pylist()
                    if known.num_rows:
                        held["numbers"].append(known.column("numbers").flatten().to_numpy())
            if held:
                yield from sums.add(*run(part, held))
            yield from sums.out()

        return all_parts

    columns = {"_row": "long", "tokens": "array<string>", "lost": "string", "word": "string", "numbers": "array<float>"}
    shaped = lambda df: df.select("_part", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    vectors = None
    for turn in range(iterations):
        met = shaped(texts).unionByName(shaped(lost.withColumnRenamed("token", "lost")))
        if vectors is not None:
            needed = texts.select("_part", F.explode("tokens").alias("word")).distinct().join(vectors, "word")
            met = met.unionByName(shaped(needed))
        dealt = met.repartitionById(tasks, F.col("_part") % tasks).sortWithinPartitions("_part")
        summed = dealt.mapInArrow(fit(turn), "word string, n long, numbers array<float>")
        vectors = summed.repartition("word").sortWithinPartitions("word").mapInArrow(_averaged, "word string, n long, numbers array<float>").select("word", "numbers")
        if turn + 1 < iterations:
            vectors = materialize(vectors, "word_vectors")
    return vectors.withColumnRenamed("numbers", "vector")


def lookup_vectors(words: DataFrame, vectors: DataFrame, size: int = 100) -> DataFrame:
    """Vector of each word, zeros when it is not in the vocabulary."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return words.join(vectors, "word", "left").select(words["*"], F.coalesce("vector", zero).alias("vector"))


def relevant_ngrams(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct two-word patterns of a text that hold a sentiment word."""
    lex = lexicon_table(messages.sparkSession).select("word")
    pairs = messages.select(*keys, F.explode(F.array_distinct(bigrams(X.words(F.col(text))))).alias("b")).select(*keys, "b.cur", "b.nxt")
    marked = pairs.join(lex.select(F.col("word").alias("cur"), F.lit(True).alias("l")), "cur", "left").join(
        lex.select(F.col("word").alias("nxt"), F.lit(True).alias("r")), "nxt", "left")
    return marked.filter(F.col("l") | F.col("r")).select(*keys, F.concat_ws(" ", "cur", "nxt").alias("pattern"))


def pattern_polarity(patterns: DataFrame) -> DataFrame:
    g = patterns.groupBy("pattern").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"), F.count("*").alias("total"))
    return g.withColumn("polarity_strength", (F.col("pos") - F.col("neg")) / F.col("total"))


def top_patterns(polarity: DataFrame, k: int = 20, by: str = "total", descending: bool = True) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by).asc()
    return polarity.orderBy(order, "pattern").limit(k)


def useful_patterns(polarity: DataFrame, min_support: int = 4, min_strength: float = 0.4) -> DataFrame:
    return polarity.filter((F.col("total") >= min_support) & (F.abs("polarity_strength") >= min_strength)).orderBy("polarity_strength", "pattern")


def tfidf_logistic(train: DataFrame, width: int = 1 << 18):
    """Term weights and a logistic model on (tokens, label).  All terms count, hashed to ``width`` places."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF

    return Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=width),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000),
    ]).fit(train)
