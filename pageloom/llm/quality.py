"""Statistics of each document's text, and a mixture model that tells prose from lists, tables and junk.

The statistics are plain counts and shares over the lines, tokens and words of a document, computed for whole
Arrow batches at once. Words are counted over all documents; those that stand in a fixed share of the documents
of a script or language are common and are sent to the tasks: their number is bounded by that share, and the
choice is alike at every size. A Gaussian mixture is fitted by expectation-maximization on the standardized
statistics of all documents, and each component is named after the inspected example nearest to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.folding import UNSPACED
from pageloom.session import written

#: Share of the documents of its script or language in which a common word stands, and documents in which it must stand at all.
COMMON_SHARE, LEAST_DOCUMENTS = 0.002, 3
#: Rounds of expectation-maximization at most, and the gain in log-likelihood a document below which they end.
ROUNDS, LEAST_GAIN = 25, 0.005
#: Statistics the mixture is fitted on, and all that are given.
MIXED = [
    "marked_share", "cell_share", "ended_share", "line_length", "sentence_rate", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "letter_share", "variety", "long_share",
]
STATISTICS = ["n_words", "n_lines", "n_printed", *MIXED, "line_end_share"]
#: Tokens in which variety is judged, letters above which a token is long, characters of texts that are measured at once.
SPAN, LONG, AT_ONCE = 60, 40, 4_000_000

HIDDEN = "[\u200b-\u200f\u2060\ufeff\u00ad\u034f]"
BREAKS = "[\n\r\u2028\u2029\x0b\x0c\x85]+"
MARKED = r"^(?:[•●◦▪*·–—+-]|\[[ xX]?\]|[(（]?(?:\d{1,3}|[a-zA-Z])[.)）]|\d+(?:\.\d+)+)\s+\S|\.{4,}|(?:\. ){4,}|…{2,}"
CELLS = r"\|.*\||\t|(?:;[^;]*){4,}|(?:,[^,\s][^,]*){5,}|\S=\S.*\S=\S|^\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\S {3,}\S.* {3,}\S"
ENDED = "[.!?。！？।؟…:：][\"'”’»“)\\]）」]*$"
STOP = "[.!?؟…][\"”’»)]*(?:\\s|$)|[。！？।]|[\u0e00-\u0e7f] [\u0e00-\u0e7f]"
SYMBOL = "[^\\pL\\pM\\pN\\s.,;:!?'’\"“”„«»()\\-–‐‑/%°。，、？！؟：「」।]"
#: First letters of scripts, each with all that follow up to the next one.
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7FF, "other"), (0xF900, "han"), (0xFB00, "other"),
)


def _cut(texts: pa.Array, pattern: str | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text number, part, length) of the parts of texts between a pattern's matches, or blanks; empty parts left out."""
    parts = pc.split_pattern_regex(texts, pattern=pattern) if pattern else pc.utf8_split_whitespace(texts)
    parent, flat = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
    flat = pc.utf8_trim_whitespace(flat) if pattern else flat
    length = pc.utf8_length(flat).to_numpy().astype(np.int64)
    there = length > 0
    return parent[there], flat.filter(pa.array(there)), length[there]


def _plain(texts: pa.Array) -> pa.Array:
    """Texts without hidden characters, compatibility forms and accents taken apart (NFKD), null as empty; words and lengths are those of this form."""
    return pc.utf8_normalize(pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=HIDDEN, replacement=""), "NFKD")


def _apart(plain: pa.Array) -> pa.Array:
    """Lower-case texts with blanks around every character of the scripts without blanks."""
    return pc.replace_substring_regex(pc.utf8_lower(plain), pattern=f"([{UNSPACED}])", replacement=r" \1 ")


def _words(apart: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text number, word, length): runs of letters of texts that are set apart."""
    return _cut(pc.replace_substring_regex(apart, pattern=r"[^\pL\pM]+", replacement=" "))


def statistics_table(texts: pa.Array, common: pa.Array) -> pd.DataFrame:
    """The STATISTICS of each text; all 0 for null, empty and blank texts."""
    plain = _plain(texts)
    n = len(plain)

    def total(parent: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(parent, weights=values, minlength=n).astype(float)

    in_text, line, length = _cut(plain, BREAKS)
    match = lambda pattern: pc.match_substring_regex(line, pattern=pattern).to_numpy(zero_copy_only=False)
    marked, ended = match(MARKED), match(ENDED)
    cells = match(CELLS) & ~marked
    lines, chars = total(in_text), np.maximum(total(in_text, length), 1)
    of_token, token, size = _cut(plain)
    printed = total(of_token, size)
    apart = _apart(plain)
    of_run, _, run = _cut(apart)
    of_word, word, letters = _words(apart)
    n_words = total(of_word)
    known = pc.is_in(word, value_set=common).to_numpy(zero_copy_only=False)
    # different tokens among any SPAN of them, however long the text
    count = total(of_token)
    place = np.arange(len(of_token)) - np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)[of_token]
    code = token.dictionary_encode().indices.to_numpy().astype(np.int64)
    spans, codes = int(place.max(initial=0)) // SPAN + 1, int(code.max(initial=0)) + 1
    different = total(np.unique((of_token * spans + place // SPAN) * codes + code) // codes // spans)
    found = lambda pattern: pc.count_substring_regex(plain, pattern=pattern).to_numpy().astype(float)
    printed_, words_, lines_ = (np.maximum(x, 1) for x in (printed, n_words, lines))
    return pd.DataFrame(
        {
            "n_words": n_words.astype(np.int32), "n_lines": lines.astype(np.int32), "n_printed": printed.astype(np.int32),
            "marked_share": total(in_text, length * marked) / chars, "cell_share": total(in_text, length * cells) / chars, "ended_share": total(in_text, length * ended) / chars,
            "line_length": np.where(lines > 0, np.log1p(chars / lines_), 0.0), "sentence_rate": np.minimum(1.0, 12 * found(STOP) / words_) * (printed > 0),
            "mean_word_length": np.minimum(20.0, total(of_word, letters) / words_), "symbol_ratio": found(SYMBOL) / printed_, "digit_ratio": found(r"\pN") / printed_,
            "common_share": total(of_word, known) / words_, "letter_share": total(of_word, letters) / printed_, "variety": different / np.maximum(count, 1),
            "long_share": np.minimum(1.0, total(of_run, run * (run > LONG)) / printed_), "line_end_share": total(in_text, ended) / lines_,
        }
    )[STATISTICS]


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Successive slices of texts, each of a bounded number of characters or a single text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
    edges = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1), len(texts)]
    for first, stop in zip(edges, edges[1:]):
        if stop > first:
            yield texts.slice(first, stop - first)


def _word_counts(texts: pa.Array, langs: pa.Array) -> pa.RecordBatch:
    """(script, lang, word, n): documents of a batch that hold each word, by script and language; the empty word stands in every document."""
    of_word, word, _ = _words(_apart(_plain(texts)))
    coded = word.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy().astype(np.int64)
    firsts = np.array([x for x, _ in SCRIPTS])
    names = sorted({x for _, x in SCRIPTS})
    of_first = np.array([names.index(x) for _, x in SCRIPTS])
    script_of = of_first[np.maximum(0, np.searchsorted(firsts, [ord(x[0]) for x in words], side="right") - 1)] if words else np.zeros(0, np.int64)
    n, k = len(texts), len(names)
    by_script = np.bincount(of_word * k + script_of[code], minlength=n * k).reshape(n, k)
    script = np.where(2 * by_script.max(axis=1) >= by_script.sum(axis=1), by_script.argmax(axis=1), k)
    lang = pc.fill_null(langs, "").dictionary_encode()
    group = script * len(lang.dictionary) + lang.indices.to_numpy()
    there = np.unique(of_word)
    held = np.unique(np.concatenate((of_word * (len(words) + 1) + code, there * (len(words) + 1) + len(words))))
    key, count = np.unique(group[held // (len(words) + 1)] * (len(words) + 1) + held % (len(words) + 1), return_counts=True)
    own, which = key // (len(words) + 1), key % (len(words) + 1)
    take = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
    columns = [take([*names, "mixed"], own // len(lang.dictionary)), take(lang.dictionary.to_pylist(), own % len(lang.dictionary)), take([*words, ""], which), pa.array(count)]
    return pa.RecordBatch.from_arrays(columns, ["script", "lang", "word", "n"])


def common_words(documents: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """(word): the words that stand in a share of the documents of one script, or of one language where ``lang`` names it, and in LEAST_DOCUMENTS of them.

    A document belongs to the script of half of its words. At most the mean number of different words in a
    document, divided by the share, for each script and language.
    """
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _portions(batch.column(0)):
                yield _word_counts(texts, batch.column(1).slice(at, len(texts)))
                at += len(texts)

    held = documents.where("text is not null").select("text", lang.alias("lang")).mapInArrow(counted, "script string, lang string, word string, n long")
    words = held.groupBy("word", "script", "lang").agg(F.sum("n").alias("n"))
    named = F.when(~F.lower(F.trim("lang")).isin("", "und"), F.concat(F.lit("lang "), F.lower(F.trim("lang"))))
    groups = words.select("word", "n", F.explode(F.array_compact(F.array(F.concat(F.lit("script "), F.col("script")), named))).alias("group"))
    counts = written(groups.groupBy("group", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_DOCUMENTS) | (F.col("word") == "")))
    sizes = counts.where("word = ''").select("group", F.col("n").alias("documents"))
    return counts.where("word <> ''").join(sizes, "group").where(F.col("n") >= share * F.col("documents")).select("word").distinct()


def _common_set(documents: DataFrame) -> pa.Array:
    return pa.array([r.word for r in common_words(documents).collect()], pa.string())


def text_statistics(documents: DataFrame, common: pa.Array | None = None) -> DataFrame:
    """Every row with its columns and the STATISTICS beside them; statistics replace columns of the same name.

    Statistics of null, empty and blank texts are 0. ``common`` is a bounded set of common words, by default
    those of the table (`common_words`); it is all that reaches the driver.
    """
    known = documents.sparkSession.sparkContext.broadcast(_common_set(documents) if common is None else common)
    kinds = ", ".join(f"{x} {'int' if x.startswith('n_') else 'double'}" for x in STATISTICS)

    @F.pandas_udf(kinds)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            portions = [statistics_table(x, known.value) for x in _portions(pa.array(batch, pa.string(), from_pandas=True))]
            yield pd.concat(portions, ignore_index=True) if portions else statistics_table(pa.array([], pa.string()), known.value)

    kept = [c for c in documents.columns if c not in STATISTICS and c != "_s"]
    return documents.withColumn("_s", measured.asNondeterministic()("text")).select(*(f"`{c}`" for c in kept), "_s.*")


# Examples of each kind, written and named by hand; none is taken from the tables.
EXAMPLES = (
    ("prose", "The oven has to be hot before the bread goes in. Turn the loaves after ten minutes, and leave the door shut until they are brown."),
    ("prose", "Opening hours\n\nThe library lends books for three weeks. Maps and old papers stay in the reading room.\nAsk at the desk if a shelf is empty."),
    ("prose", "Tray 14-B of the bakery holds 36 rolls at 5 °C. Ms. Ada baked them in 2011; who bought the rest?"),
    ("prose", "Since May 2011, Ms. Ada has baked 36 rolls a day in oven\n14-B of the old bakery, and the rest of the dough\nwaits at 5 °C until the evening. Never open it\nbefore noon!"),
    ("prose", "In 2011 the gardener moved tulips 14-B to the park\nat the river."),
    ("prose", "माली बगीचा 14-B में हर सुबह 36 गुलाबों को पानी\nदेता है। 2011 से फाटक गर्मियों में खुला रहता\nहै। रसोइया रोटी को 5 °C पर रखता है।"),
    ("prose", "El pan sale del horno cuando está dorado. La panadera limpia la mesa cada noche."),
    ("prose", "Le jardinier arrose les roses chaque matin. La grille du parc reste ouverte en été."),
    ("prose", "Der Gärtner gießt jeden Morgen die Rosen. Das Tor zum Park bleibt im Sommer offen."),
    ("prose", "Садовник поливает розы каждое утро. Калитка 14-Б в парке летом открыта до 21 часа."),
    ("prose", "园丁每天早上给玫瑰浇水。公园的大门在夏天一直开到 21 点。"),
    ("prose", "庭師は毎朝バラに水をやる。公園の門は夏のあいだ21時まで開いている。"),
    ("prose", "14-B 号烤箱放着 36 个面包，温度不低于 5 °C。“谁开了门？”面包师问道。"),
    ("prose", "14-B のかまどには 5 °C でパンが 36 個ある。「誰が戸を開けたのか」とパン屋は言った。"),
    ("prose", "คนสวนรดน้ำกุหลาบทุกเช้า ประตูสวนเปิดถึง 21 นาฬิกาในฤดูร้อน"),
    ("prose", "แม่ครัวล้างโต๊ะทุกคืนก่อนกลับบ้าน"),
    ("prose", "माली हर सुबह गुलाबों को पानी देता है। बगीचे का फाटक गर्मियों में खुला रहता है।"),
    ("prose", "يسقي البستاني الورود كل صباح. تبقى بوابة الحديقة B-14 مفتوحة حتى 21 في الصيف. من أغلقها؟"),
    ("prose", "Ο κηπουρός ποτίζει τα τριαντάφυλλα κάθε πρωί. Η πύλη B-14 του κήπου μένει ανοιχτή ως τις 21. Ποιος την έκλεισε;"),
    ("prose", "For the dough you need a few things.\n- flour;\n- warm water;\n- a little salt.\nThe baker mixes them slowly, and then the dough rests for an hour under a cloth. Nobody should open the window in the meantime, because the dough would get cold."),
    ("list", "- flour\n- yeast\n- salt\n- brown sugar\n- warm milk\n- butter"),
    ("list", "1. roses\n2. tulips\n3. white lilies\n4. ferns\n5. old oaks"),
    ("list", "[ ] feed the cat\n\n[ ] water the ferns\n\n[ ] sweep the path\n\n[ ] post the letters"),
    ("list", "Contents\nSpring ........ 4\nSummer ............ 19\nAutumn ......... 37\nWinter ....... 52"),
    ("list", "Menu\nsoup\nbrown bread\nsalad\napple pie\ntea\ncold milk"),
    ("list", "wash the pots;\n\ndry spoons\n\nfill jars;\n\nset the table\n\nlight the candles"),
    ("list", "Jobs for the fair 2011\nwash pots.\n\ndry spoons;\n\nfill jars\n\nset tables.\n\nlight candles;\n\nsweep floors.\n\nstack chairs\n\nfold napkins."),
    ("list", "菜单\n黑面包\n5°C以下的牛奶\n苹果\n36号茶\n沙拉\n汤"),
    ("list", "メニュー\n黒パン\n5°C以下の牛乳\nりんご\n36番のお茶\nサラダ\nスープ"),
    ("list", "– 玫瑰\n– 百合\n– 面粉\n– 热牛奶\n– 苹果"),
    ("table", "| flower | height | colour |\n| rose | 70 | red |\n| lily | 95 | white |\n| fern | 40 | green |"),
    ("table", "loaf\tgrams\tprice\nrye\t750\t3.20\nspelt\t500\t3.90\nwheat\t1000\t2.75"),
    ("table", "loaf=rye grams=750 price=3.20\nloaf=spelt grams=500 price=3.90\nloaf=wheat grams=1000 price=2.75"),
    ("table", "1999-12-31T23:58 kitchen: oven door=open heat=210\n1999-12-31T23:59 kitchen: oven door=shut heat=205\n2000-01-01T00:07 kitchen: oven door=open heat=180"),
    ("table", '"loaf";"grams";"price";"sold"\n"rye";750;3.20;41\n"spelt";500;3.90;12'),
    ("junk", "Vkqz wpl trwmk xxgh dqpzr mwl. Nqzt bbwk hqlr ztpk vqj. Mkzw xptm jjvk bwq ffmt hqk vlz."),
    ("junk", "Zplk qwtr mhgv xxj. Vbnq ktrl wpzz hgqk mlvx qqp trkz bnhw. Plmx vvkq zrth gwpq kkj hbnt mqlz xvw. Trpq lkzh wmbv qnx jjkt hgpl zzwq vrkm. Qlkh mmzp xwtr bgvq nkjz ppl hrtw kqzv mxb"),
    ("junk", "Qm7Zt2LwPx9RkB4nVc6HsJ1dYf8GaTe3UoIi5XbNzMqWvErTyUpAsDfGhJkLzXcVbNmQ1w2E3r4T5y6U7i8O9p0LkJhGfDs"),
    ("junk", "b@k~ |th§ r#se g¦rd%n {w¬ter} p|th ~pen§ s#mm¦r t@ble gr%ss |le¬f b#rk"),
    ("junk", "a91f 07c3 5be2 88d0 f4a7 1c6e e035 92bb 6d4f c8a1 30e9 57d2 b16c 4fa8 09e5 d73b"),
    ("junk", "red rose red rose red rose red rose red rose red rose red rose red rose red rose red rose red rose red rose red rose red rose"),
    ("junk", "%%%%%%\n. . . . .\n+++++++\n*****\n@@@@ QL-7\n,,,,,,\n<<<<<<\n%%%%%%"),
)


#: Least variance of a component in each statistic, standardized.
LEAST_VARIANCE = 0.05


class Mixture:
    """A Gaussian mixture on standardized statistics: weights, means and covariances, small and broadcast whole."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: np.ndarray) -> None:
        self.centre, self.scale, self.means = centre, scale, means
        self.weights = np.full(len(means), 1 / len(means))
        self.covariances = np.repeat(np.eye(means.shape[1])[None] * 0.5, len(means), axis=0)

    def standardized(self, values: np.ndarray) -> np.ndarray:
        return (values - self.centre) / self.scale

    def responsibilities(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each component in each (standardized) point, and the point's log-likelihood but for a constant."""
        logs = np.empty((len(points), len(self.means)))
        for k, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances)):
            factor = np.linalg.cholesky(covariance)
            apart = np.linalg.solve(factor, (points - mean).T)
            logs[:, k] = np.log(weight) - 0.5 * (apart**2).sum(axis=0) - np.log(np.diag(factor)).sum()
        top = logs.max(axis=1, keepdims=True)
        shares = np.exp(logs - top)
        whole = shares.sum(axis=1, keepdims=True)
        return shares / whole, (top + np.log(whole))[:, 0]


def fit_mixture(points: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over a table with the columns MIXED, from the given (unstandardized) means.

    A round is one pass of Spark: every partition adds up its responsibilities and moments, which are
    summed by component; one small row for each component reaches the driver. Rounds end when a document's
    log-likelihood gains less than LEAST_GAIN on average.
    """
    spark = points.sparkSession
    row = points.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(MIXED)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(MIXED))).first()
    d = len(MIXED)
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(d)])
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    mixture = Mixture(centre, scale, (start - centre) / scale)
    k = len(start)
    values, before = points.select(*MIXED), -np.inf
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(mixture)

        def moments(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = sent.value
            total = np.zeros((k + 1, 1 + d + d * d))  # the last row holds the log-likelihood
            for batch in batches:
                x = own.standardized(batch.to_numpy(float))
                shares, likelihood = own.responsibilities(x)
                total[:k, 0] += shares.sum(axis=0)
                total[:k, 1 : 1 + d] += shares.T @ x
                total[:k, 1 + d :] += shares.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                total[k, 0] += likelihood.sum()
            yield pd.DataFrame({"component": range(k + 1), "sums": [*total]})

        summed = values.mapInPandas(moments, "component int, sums array<double>").select("component", F.posexplode("sums").alias("place", "value"))
        summed = summed.groupBy("component", "place").agg(F.sum("value").alias("value"))
        sums = np.zeros((k + 1, 1 + d + d * d))
        for r in summed.collect():
            sums[r.component, r.place] = r.value
        sent.destroy()
        rows = sums[:k, 0].sum()
        if not rows:
            break
        mixture = Mixture(centre, scale, mixture.means.copy())
        mixture.weights = np.maximum(sums[:k, 0] / rows, 1e-12)
        for i in range(k):
            if sums[i, 0] > 1e-6:
                mean = sums[i, 1 : 1 + d] / sums[i, 0]
                mixture.means[i] = mean
                mixture.covariances[i] = sums[i, 1 + d :].reshape(d, d) / sums[i, 0] - np.outer(mean, mean) + np.eye(d) * LEAST_VARIANCE
        gain, before = sums[k, 0] / rows - before, sums[k, 0] / rows
        if gain < LEAST_GAIN:
            break
    return mixture


def classify(documents: DataFrame, keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Every row with its columns (or those to keep), the STATISTICS, ``kind`` (prose, list, table, junk; null without text) and ``prose_probability``.

    The mixture starts with one component at each inspected example; a fitted component is named after the
    kind of the example nearest to its mean.
    """
    common = _common_set(documents)
    kept = [c for c in (documents.columns if keep is None else keep) if c not in STATISTICS]
    measured = written(text_statistics(documents, common).select(*(f"`{c}`" for c in kept), *STATISTICS))
    filled = measured.where("n_printed > 0")
    # the examples' own languages need not be those of the corpus
    told = [text for kind, text in EXAMPLES if kind != "junk"]
    read = pa.chunked_array([common, _words(_apart(_plain(pa.array(told))))[1]]).combine_chunks()
    examples = statistics_table(pa.array([text for _, text in EXAMPLES]), read)[MIXED].to_numpy(float)
    kinds = [kind for kind, _ in EXAMPLES]
    mixture = fit_mixture(filled, examples, rounds)
    points = mixture.standardized(examples)
    names = [kinds[int(((points - mean) ** 2).sum(axis=1).argmin())] for mean in mixture.means]
    sent = documents.sparkSession.sparkContext.broadcast((mixture, names))

    @F.pandas_udf("kind string, prose_probability double")
    def decided(*columns: pd.Series) -> pd.DataFrame:
        own, called = sent.value
        shares, _ = own.responsibilities(own.standardized(np.column_stack(columns)))
        by_kind = pd.DataFrame({kind: shares[:, [i for i, x in enumerate(called) if x == kind]].sum(axis=1) for kind in ("prose", "list", "table", "junk")})
        return pd.DataFrame({"kind": by_kind.idxmax(axis=1), "prose_probability": by_kind["prose"]})

    kept = [c for c in measured.columns if c not in ("kind", "prose_probability", "_k")]
    scored = measured.withColumn("_k", decided.asNondeterministic()(*MIXED)).select(*(f"`{c}`" for c in kept), F.when(F.col("n_printed") > 0, F.col("_k.kind")).alias("kind"), F.when(F.col("n_printed") > 0, F.col("_k.prose_probability")).alias("prose_probability"))
    return scored
