"""Language identification by a byte convolutional network (operator 4).

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter's largest answer over the window is kept, and a softmax
layer gives the languages' probabilities. Training is plain numpy (Adam) on
the driver, on a bounded sample of labelled windows; a filter over embedded
bytes is a sum of one table row for each of its bytes, and those of two bytes
are summed ahead for prediction. A text is predicted from all its windows:
the mean of their log-probabilities, by bytes.

Sample: of each language, the PER_LANG rows of the smallest hash of their id
(fewer languages than LANGS; beyond, fewer rows of each, SAMPLE in all), and
of each row up to PER_TEXT windows spread over the text. Only these windows,
PER_TEXT * WINDOW bytes a row, come to the driver.

Cases: a null or empty text, or one without a letter, is ``und`` with score 0;
so is every text if nothing can be learned from. Rows without a language or an
id are predicted but not learned from. Equal texts get equal answers; of
equally likely languages, the first by name. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import add_columns, sample_of_each, utf8_slices

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANG, LANGS, PER_TEXT = 800, 8, 3
SAMPLE = PER_LANG * LANGS
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows that are predicted at a time.
BLOCK = 512


def windows(data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (n, WINDOW) that cover a text's bytes, padded with 0, and how many bytes each has.

    Windows overlap by a filter's width less one, so no run of bytes is missed.
    """
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(end - begin - max(WIDTHS) + 1) // step))
    room = np.zeros((n - 1) * step + WINDOW, np.uint8)
    room[:end - begin] = data[begin:end]
    length = np.minimum(WINDOW, end - begin - step * np.arange(n))
    return np.lib.stride_tricks.sliding_window_view(room, WINDOW)[::step], length


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))),
                  "out_b": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Pooled answers (n, filters) before the rectifier, and where each was largest."""
        top, at = [], {}
        for w in WIDTHS:
            table = self.p["embed"] @ self.p[f"w{w}"]  # (w, 256, filters)
            n = x.shape[1] - w + 1
            answer = table[0][x[:, :n]]
            for j in range(1, w):
                answer += table[j][x[:, j:j + n]]
            at[w] = answer.argmax(axis=1)
            top.append(np.take_along_axis(answer, at[w][:, None], 1)[:, 0] + self.p[f"b{w}"])
        return np.concatenate(top, axis=1), at

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self.pooled(x)
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.p["out"] + self.p["out_b"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"out": hidden.T @ p, "out_b": p.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (p @ self.p["out"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            mine = back[:, k * FILTERS:(k + 1) * FILTERS]
            bytes_ = x[np.arange(len(x))[:, None, None], at[w][:, :, None] + np.arange(w)]  # (n, filters, w)
            g[f"w{w}"] = np.einsum("nf,nfjd->jdf", mine, self.p["embed"][bytes_])
            g[f"b{w}"] = mine.sum(axis=0)
            np.add.at(g["embed"], bytes_, np.einsum("nf,jdf->nfjd", mine, self.p[f"w{w}"]))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                some = order[i:i + BATCH]
                for k, g in self.gradients(x[some], y[some]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def ready(self) -> Network:
        """Sum the table rows of each two bytes ahead."""
        self.two = {}
        for w in WIDTHS:
            table = self.p["embed"] @ self.p[f"w{w}"]
            self.two[w] = [(table[j][:, None] + table[j + 1][None]).reshape(-1, FILTERS) if j + 1 < w else table[j]
                           for j in range(0, w, 2)]
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages) for windows, BLOCK at a time."""
        out = []
        for i in range(0, len(x), BLOCK):
            one = x[i:i + BLOCK].astype(np.int32)
            pair = one[:, :-1] * 256 + one[:, 1:]
            top = []
            for w in WIDTHS:
                n = one.shape[1] - w + 1
                answer = None
                for j, table in enumerate(self.two[w]):
                    at = pair if 2 * j + 1 < w else one
                    rows = table[at[:, 2 * j:2 * j + n]]
                    answer = rows if answer is None else np.add(answer, rows, out=answer)
                top.append(answer.max(axis=1) + self.p[f"b{w}"])
            z = np.maximum(np.concatenate(top, axis=1), 0) @ self.p["out"] + self.p["out_b"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on the sample of the rows that aren't held out; None if there are none."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"\p{L}")
                      & ~held_out(F.col(doc_id)))
    known = rows.agg(F.count_distinct(lang)).first()[0]
    each = max(1, min(PER_LANG, SAMPLE // max(1, known)))
    # which rows first, by id alone
    chosen = sample_of_each(rows.select(lang, doc_id), lang, doc_id, each).distinct().limit(max(SAMPLE, known))
    sample = rows.join(F.broadcast(chosen), [lang, doc_id], "left_semi").select(lang, doc_id, text)

    def make():
        def work(column):
            data, at = utf8_slices(column)
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                found = windows(data, a, b)[0]
                pick = np.unique(np.linspace(0, len(found) - 1, PER_TEXT).astype(int))
                out.append(np.ascontiguousarray(found[pick]).tobytes())
            return [pa.array(out, pa.binary())]
        return work

    cut = add_columns(sample, [text], [T.StructField("windows", T.BinaryType())], make, [text])
    # of rows of one id and language, that of the least windows, so that reruns agree
    one = cut.groupBy(lang, doc_id).agg(F.min("windows").alias("windows"))
    got = sorted(one.collect(), key=lambda r: (r[lang], r[doc_id]))
    if not got:
        return None
    langs = sorted({r[lang] for r in got})
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got]
    y = np.repeat([langs.index(r[lang]) for r in got], [len(a) for a in x])
    return Network(langs).fit(np.concatenate(x), y)


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    letters = docs.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value.ready() if shared.value else None

        def work(column, letters):
            data, at = utf8_slices(column)
            lang, score = ["und"] * len(column), np.zeros(len(column))
            real = [i for i, ok in enumerate(letters.to_pylist()) if ok and net]
            group: list[int] = []
            size = 0
            for k, i in enumerate(real):
                group.append(i)
                size += at[i + 1] - at[i]
                if size < BLOCK * WINDOW and k + 1 < len(real):
                    continue
                cut = [windows(data, at[j], at[j + 1]) for j in group]
                logs = net.log_probabilities(np.concatenate([x for x, _ in cut]))
                length = np.concatenate([n for _, n in cut])
                first = np.cumsum([0, *[len(n) for _, n in cut]])[:-1]
                mean = np.add.reduceat(logs * length[:, None], first) / np.add.reduceat(length, first)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for j, q in zip(group, p, strict=True):
                    best = int(q.argmax())
                    lang[j], score[j] = net.langs[best], float(q[best])
                group, size = [], 0
            return [pa.array(lang, pa.string()), pa.array(score)]
        return work

    return add_columns(letters, [text, "__letters"], [T.StructField("lang_pred", T.StringType()),
                                                      T.StructField("score", T.DoubleType())], make, [text, "__letters"])
