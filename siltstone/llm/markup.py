"""Markup residue in text documents: a recurrent block labeller, and the clean text.

A chunk is a sequence of leaves (its lines that aren't blank). Each leaf is a vector: its tag path
(the HTML elements, fences and environments open there), its words and signs, both hashed, and its
outline. A bidirectional LSTM in numpy reads the sequence, so a leaf is labelled with what comes
before and after it, and says for each leaf how likely it holds HTML, Markdown, wiki or LaTeX
markup or is sample code. It was trained on ``TRAIN_DOCS`` documents written by
the generator below with known labels; nothing is fitted to the data it is used on. Among its inputs
is what patterns see in a leaf (``rules``); whether that is markup, a sign in prose or part of a
sample is for the network to say.

A chunk that begins inside a fence, ``<pre>`` or listing of its file is read with that open: the
signs that open and close them are gathered from all chunks of a document file and followed in its
order (see ``seeds``).

A kind is reported where a leaf holds it with a probability of at least ``DECIDE``. The clean text is
made from the same labels.
"""

from __future__ import annotations

import html as html_entities
import json
import os
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.tables import spread, stage

KINDS = ["html", "markdown", "wiki", "latex"]
LABELS = [*KINDS, "code"]
#: Extensions of document files.
DOCUMENTS = ["md", "markdown", "html", "htm", "wiki", "tex", "txt", "docx", "odt"]
TRAIN_DOCS = 5000
WEIGHTS = os.path.join(os.path.dirname(__file__), "markup_weights.npz")
DECIDE = 0.5
CODE_SURE = 0.7
FEW = 500_000
#: Chunks of a file that are followed at once; a longer file's buckets are combined.
BUCKET = 1024
PATH_DIM, WORD_DIM, SIGN_DIM, HIDDEN = 16, 32, 96, 24
RULES = 7
INPUTS = PATH_DIM + WORD_DIM + SIGN_DIM + RULES + 6

#: HTML element names.
ELEMENTS = (
    "html head body title meta link script style p div span a ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 b i u s em strong small big br hr img pre code kbd samp"
    " var sup sub blockquote q cite abbr section article nav header footer main aside figure figcaption form input button label select option textarea iframe font center tt strike del ins mark"
).split()
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_TAG = re.compile(rf"<(/?)({_NAMES})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(/?)>", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_SPAN = re.compile(r"(`+)(?!`)[^\n]*?[^`\n]\1(?!`)")
SIGNS = {
    "html": re.compile(_TAG.pattern + r"|<!--|-->|<!DOCTYPE\b|" + _ENTITY.pattern, re.I),
    "markdown": re.compile(
        r"^ {0,3}\#{1,6}[ \t]+\S|^ {0,3}(?:```|~~~)|!?\[[^\[\]\n]+\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"]*\")?\)|(?<![\w*\\])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])"
        r"|(?<![\w_\\])__(?=[^\s_])[^\n]*?[^\s_]__(?!\w)|(?<![\w_\\*])_(?=[^\s_])[^_\n]*[^\s_]_(?!\w)|(?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w~])~~(?=[^\s~])[^~\n]*[^\s~]~~(?![\w~])|^\s*[-*+] \[[ xX]\] |^\s*\|?\s*:?-{3,}:?\s*\|[\s:|-]*$"
        r"|^\s*\|(?![-}|])[^|\n]*\|.*\|\s*$|(?<![\w\])}])\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^> {0,3}[^\W\d]|^\[[^\]\n]+\]:\s+\S"
    ),
    "wiki": re.compile(r"^(={2,6})[^=\n].*?\1\s*$|\[\[(?!\s)[^\[\]\n]+\]\]|(?<!')'{2,3}(?![\s'])[^'\n](?:[^\n]*?[^\s'])?'{2,3}(?!')|\{\{[^\s{}][^{}\n]*\}\}|^\{\||^\|\}|^\|-|^\{\{\w|^\[https?://\S+ [^\]]+\]"),
    "latex": re.compile(
        r"(?<![:\w\\])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{|(?:item|le|ge|leq|geq|sum|prod|int|alpha|beta|gamma|infty|times|cdot|ldots|dots|noindent|maketitle|hline|centering|par|newpage|tableofcontents)\b)"
        r"|^\s*\\[\[\]]\s*$|\\\(.+?\\\)|(?<![\w$\\])\$(?=\S)[^$\n]*(?:\\[A-Za-z]+|[_^][{\d])[^$\n]*\$(?!\d)|\}~?\\ref\{|\w~\\(?:ref|cite)\{"
    ),
}
#: A sign of a kind holds one of these.
_CHARS = {"html": re.compile(r"[<&]|-->"), "markdown": re.compile(r"[#`~\[*_|>]"), "wiki": re.compile(r"[=\['{|}]"), "latex": re.compile(r"[\\$]")}
_PRE_OPENS = re.compile(r"<pre\b(?!.*</pre)", re.I)
_SETEXT = re.compile(r"^ {0,3}(?:={3,}|-{3,})\s*$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_TOKEN = re.compile(r"</?[A-Za-z][\w-]*|\\[A-Za-z]+|[^\W\d_]+|\d+|&[#\w]+;|\[\[|\]\]|\]\(|\{\{|\}\}|\{\||\|\}|'{2,3}|={2,}|-{3,}|\#+|`+|~{3}|\*+|[^\w\s]")
_TIGHT = re.compile(r"[^\w\s.,]+\w+|\w+[^\w\s.,]+")  # a sign and the word that it touches
_WORDS = re.compile(r"\w+")
_LETTER = re.compile(r"[^\W\d_]")
_HELD_TAG = re.compile(r"</?(?:pre|code)\b", re.I)
_HELD_END = re.compile(r"\\end\{(?:verbatim|lstlisting)\}")
#: Words of programming languages and of prose that tell sample code from sentences.
_KEPT = frozenset(
    "the a of and to that is in it if we der die das und wenn wird für le la les un et est que pour el los las una por que en y"
    " def return for while if else switch case let mut fn const func var await async match class new import from public static void int throw defer assert with self select insert update create".split()
)


# ---- leaves and their vectors


def _slot(text: str, dim: int) -> tuple[int, float]:
    h = crc32(text.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & 0x80000000 else -1.0


_SLOTS: dict[tuple[str, int], tuple[int, float]] = {}


def _hashed(tokens: list[str], dim: int) -> np.ndarray:
    v = np.zeros(dim, np.float32)
    for t in tokens:
        at = _SLOTS.get((t, dim))
        if at is None:
            if len(_SLOTS) > 100_000:
                _SLOTS.clear()
            at = _SLOTS[t, dim] = _slot(t, dim)
        v[at[0]] += at[1]
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def _present(tokens: set[str]) -> np.ndarray:
    v = np.zeros(SIGN_DIM, np.float32)
    for t in sorted(tokens):
        at = _SLOTS.get((t, SIGN_DIM))
        if at is None:
            at = _SLOTS[t, SIGN_DIM] = _slot(t, SIGN_DIM)
        v[at[0]] += at[1]
    return np.clip(v, -2, 2)


@lru_cache(maxsize=1 << 16)
def _shown(token: str) -> str:
    """Words of no known meaning count by their case only, numbers as such; signs and names of tags count themselves."""
    if token[0].isalpha():
        low = token.lower()
        return low if low in _KEPT else ("Aa" if token[0].isupper() else "aa")
    return "0" if token[0].isdigit() else token.lower()


#: Letters, in a state, of what holds sample code besides fences. A state is the open fence and the letters of the rest that is open.
_HELD = {"p": "pre", "v": "env:verbatim", "l": "env:lstlisting"}
_ALL = "".join(_HELD)
_HOLDS = re.compile(r"`{3}|~{3}|</?pre\b|\\(?:begin|end)\{(?:verbatim|lstlisting)", re.I)
_LISTING = re.compile(r"\\(begin|end)\{(verbatim|lstlisting)\*?\}")


def _fence(line: str) -> tuple[str, bool] | None:
    """The run of fence signs that a line begins with, and whether it is all of the line. A run of backticks with others after it is a code span."""
    m = _FENCE.match(line)
    if not m:
        return None
    run, rest = m.group(1), line[m.end() :]
    return None if run[0] == "`" and "`" in rest else (run, not rest.strip())


def leaves(text: str, state: str = "") -> list[tuple[str, tuple[str, ...]]]:
    """``(line, tag path)`` of the lines that aren't blank. The path names what is open before the line, and what encloses all of it.

    ``state`` is what the text begins in.
    """
    out: list[tuple[str, tuple[str, ...]]] = []
    fence = state.rstrip(_ALL)
    path = [_HELD[x] for x in state[len(fence) :]]
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.strip():
            continue
        run, bare = _fence(line) or ("", False)
        if run and (not fence or (bare and run.startswith(fence))):
            out.append((line, (*path, "fence-end" if fence else "fence-start")))
            fence = "" if fence else run
            continue
        if fence:
            out.append((line, (*path, "fence")))
            continue
        out.append((line, tuple(path)))
        for t in _TAG.finditer(line):
            name = t.group(2).lower()
            if t.group(1):
                if name in path:
                    del path[len(path) - 1 - path[::-1].index(name) :]
            elif not t.group(3) and name not in ("br", "hr", "img", "meta", "link", "input"):
                path.append(name)
        for e in re.finditer(r"\\(begin|end)\{(\w+)\*?\}", line):
            if e.group(1) == "begin":
                path.append("env:" + e.group(2))
            elif "env:" + e.group(2) in path:
                path.remove("env:" + e.group(2))
    return out


# ---- what is open where a chunk begins


def holds(text: str) -> list[tuple[int, str]]:
    """Line (from 0) and sign of all that may open or close a fence (its run, with ``.`` if it is all of the line), ``<pre>`` or listing (``+p``, ``-p``)."""
    out: list[tuple[int, str]] = []
    if not _HOLDS.search(text):
        return out
    for i, line in enumerate(text.split("\n")):
        if not _HOLDS.search(line):
            continue
        if found := _fence(line):
            out.append((i, found[0] + "." * found[1]))
            continue
        bare = _SPAN.sub("`x`", line)
        out += [(i, ("-" if m.group(1) else "+") + "p") for m in _TAG.finditer(bare) if m.group(2).lower() == "pre" and not m.group(3)]
        out += [(i, ("+" if m.group(1) == "begin" else "-") + m.group(2)[0]) for m in _LISTING.finditer(bare)]
    return out


def advance(state: str, signs: list[str]) -> str:
    """The state after some signs. Within a fence only its end counts."""
    fence = state.rstrip(_ALL)
    held = set(state[len(fence) :])
    for sign in signs:
        if sign[0] in "`~":
            run = sign.rstrip(".")
            if not fence:
                fence = run
            elif run != sign and run.startswith(fence):
                fence = ""
        elif not fence:
            (held.add if sign[0] == "+" else held.discard)(sign[1])
    return fence + "".join(x for x in _ALL if x in held)


def effect(signs: list[str]) -> list[tuple[str, str, str]]:
    """What some signs do to any state: ``(fence, state after it alone, state after it and all else open)`` for no fence and the longest fence that each closing line is the first to end."""
    fences = {""}
    for c in "`~":
        longest = 0
        for sign in signs:
            if sign[0] == c and sign[-1] == "." and len(sign) - 1 > longest:
                longest = len(sign) - 1
                fences.add(c * longest)
    return [(f, advance(f, signs), advance(f + _ALL, signs)) for f in sorted(fences)]


def apply(done: list[tuple[str, str, str]], state: str) -> str:
    """The state after signs of which only the effect is known. A fence that none of them ends stays, and so does what is open in it."""
    fence = state.rstrip(_ALL)
    for f, least, most in done:
        if f.startswith(fence) and (fence or not f):
            out = least.rstrip(_ALL)
            held = state[len(fence) :]
            return out + "".join(x for x in _ALL if x in most[len(out) :] and (x in least[len(out) :] or x in held))
    return state


def own_signs(rows: list[dict]) -> list[list[str]]:
    """For each chunk in a file's order its signs on lines that no later chunk repeats.

    Chunks that begin at one line are pieces of it, and all but the first begin within that line,
    where no fence begins.
    """
    out = []
    for k, r in enumerate(rows):
        first, after = r["start_line"], rows[k + 1]["start_line"] if k + 1 < len(rows) else None
        inside = k > 0 and rows[k - 1]["start_line"] == first
        stop = after if after is not None and after > first else None
        out.append([x for n, x in zip(r["at"] or [], r["sign"] or [], strict=True) if (stop is None or first + n < stop) and not (inside and n == 0 and x[0] in "`~")])
    return out


def rules(found: list[tuple[str, tuple[str, ...]]], i: int) -> tuple[bool, ...]:
    """What patterns see in a leaf: a sign of each kind outside code spans, an underline of the line before, and entities or tags and the end of a listing within held code."""
    line, path = found[i]
    held = any(x in ("pre", "env:verbatim", "env:lstlisting") for x in path)
    bare = _SPAN.sub("`x`", line) if "`" in line else line
    setext = bool(i and line.lstrip()[:1] in ("=", "-") and _SETEXT.match(line) and _LETTER.search(found[i - 1][0]) and len(line.strip()) >= 0.5 * len(found[i - 1][0].strip()))
    return (
        *(bool(_CHARS[k].search(line)) and (bool(SIGNS[k].search(bare)) or (k == "markdown" and bare != line)) for k in KINDS), setext,
        held and "fence" not in path and not any(x.startswith("env:") for x in path) and bool(_ENTITY.search(line) or _HELD_TAG.search(line)), held and bool(_HELD_END.search(line)),
    )


def vectors(found: list[tuple[str, tuple[str, ...]]]) -> np.ndarray:
    out = np.zeros((len(found), INPUTS), np.float32)
    for i, (line, path) in enumerate(found):
        tokens = [_shown(t) for t in _TOKEN.findall(line)]
        tight = {m.group() for m in _TIGHT.finditer(line)}
        n = max(1, len(line))
        letters = sum(map(str.isalpha, line))
        if path:
            out[i, :PATH_DIM] = _hashed(list(path[-6:]), PATH_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = _hashed(tokens, WORD_DIM)
        first = "^" + tokens[0] if tokens else "^"
        signs = {t for t in tokens if not (t[0].isalnum() or t in ".,")} | {_WORDS.sub("a", t) for t in tight} | {first, "$" + (tokens[-1] if tokens else "")}
        out[i, PATH_DIM + WORD_DIM : PATH_DIM + WORD_DIM + SIGN_DIM] = _present(signs)
        out[i, -6 - RULES : -6] = rules(found, i)
        indent = len(line) - len(line.lstrip())
        out[i, -6:] = (min(indent, 8) / 8, letters / n, min(n, 200) / 200, line.rstrip().endswith((";", "{", "}", ":")), line.rstrip().endswith("."), any(p.startswith(("fence", "pre", "env:verb", "env:lst")) for p in path))
    return out


# ---- the labeller


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each label. Sequences are padded and masked."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["x" + d], self.p["h" + d] = scale(inputs, 4 * hidden), scale(hidden, 4 * hidden)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1
        self.p["o"], self.p["q"] = scale(2 * hidden, len(LABELS)), np.zeros(len(LABELS), np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, kept = np.zeros((n, steps, k), np.float32), []
        into = x @ self.p["x" + d] + self.p["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[:, t] + h @ self.p["h" + d]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((t, i, f, o, g, c, h, tc, m))
            c, h = m * new + (1 - m) * c, m * o * tc + (1 - m) * h
            out[:, t] = h
        return out, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in ("f", "b")], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["q"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in ("f", "b")}
        both = np.concatenate([runs[d][0] for d in ("f", "b")], axis=2)
        delta = (_sigmoid(both @ self.p["o"] + self.p["q"]) - y) * mask[:, :, None] / max(1.0, float(mask.sum()))
        g = {"o": np.einsum("ntk,ntl->kl", both, delta), "q": delta.sum((0, 1))}
        back, k = delta @ self.p["o"].T, self.hidden
        for d, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            for t, i, f, o, cand, c, h, tc, m in reversed(runs[d][1]):
                dh = dh + part[:, t]
                step, through = dh * m, dh * (1 - m)
                dnew = dc * m + step * o * (1 - tc * tc)
                dz = np.concatenate([dnew * cand * i * (1 - i), dnew * c * f * (1 - f), step * tc * o * (1 - o), dnew * i * (1 - cand * cand)], axis=1)
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh, dc = through + dz @ self.p["h" + d].T, dnew * f + dc * (1 - m)
            g["h" + d], g["c" + d] = gh, dz_all.sum((0, 1))
            g["x" + d] = np.einsum("nti,ntz->iz", x, dz_all)
        return g

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the logistic loss."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m, v, t = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), 8 * batch):  # documents of like length go together, which saves padding
                order[lo : lo + 8 * batch] = sorted(order[lo : lo + 8 * batch], key=lambda i: len(docs[i][0]))
            for at in range(0, len(order), batch):
                x, mask, y = padded([docs[i][0] for i in order[at : at + batch]], [docs[i][1] for i in order[at : at + batch]])
                g, t = self.gradients(x, mask, y), t + 1
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 1.0 / (norm + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * w, 0.999 * v[k] + 0.001 * w * w
                    self.p[k] -= rate * (0.5 if epoch > epochs * 2 // 3 else 1.0) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max([1, *map(len, xs)])
    x = np.zeros((len(xs), steps, INPUTS), np.float32)
    mask, y = np.zeros((len(xs), steps), np.float32), np.zeros((len(xs), steps, len(LABELS)), np.float32)
    for i, a in enumerate(xs):
        x[i, : len(a)], mask[i, : len(a)] = a, 1
        if ys is not None:
            y[i, : len(a)] = ys[i]
    return x, mask, y


# ---- documents to learn from


class Writer:
    """Writes documents in one markup, or none, with the labels of every line."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def pick(self, *options):
        return self.rng.choice(options)

    def word(self) -> str:
        w = "".join(self.pick(*"bdfghklmnprstvz") + self.pick(*"aeiou") for _ in range(self.rng.randrange(1, 4)))
        return w + self.pick("", "", "", "r", "n", "s", "_" + self.pick("cache", "index", "model"))

    def words(self, lo: int, hi: int) -> str:
        few = "the a of and to that is in it if we der die das und wenn wird für le la les un et est que pour el los las una por en y".split()
        return " ".join(self.word() if self.rng.random() < 0.6 else self.pick(*few) for _ in range(self.rng.randrange(lo, hi)))

    def sentence(self) -> str:
        odd = self.rng.random()
        if odd < 0.12:
            a, b = self.word(), self.word()
            return self.pick(
                f"Issue #{self.rng.randrange(99)} asks for C# bindings [sic] in {a}_{b}.py and {b}_{a}.rs, see [{self.rng.randrange(9)}] and {a}[{b}].",
                f"Set {a}_{b}_index before {b}_{a}_index; C:\\{a}_{b}\\{b}_{a} is the {self.pick('old', 'new')} path of {a}_{b}.",
                f"The check holds while {self.rng.randrange(99)} < {self.rng.randrange(999)} and {self.rng.randrange(999)} > {self.rng.randrange(99)}, or {a} -> {b} is <= {self.rng.randrange(99)}.",
                f"{a.capitalize()} & {b} use {self.rng.randrange(9)} * {self.rng.randrange(9)} * {self.rng.randrange(9)} slots, __init__ and *args aside, ~{self.rng.randrange(9)} {b}.",
                f"Call {self.word()}({self.word()}) only if {self.word()} == {self.word()}, never if {self.word()} != {self.word()}.",
                f"It holds while {self.rng.randrange(99)} < {self.rng.randrange(999)} and {self.rng.randrange(99)} > 12, so {self.rng.randrange(99)} & {self.rng.randrange(99)} stay apart.",
                f"It costs ${self.rng.randrange(1, 9)} per month, not ${self.rng.randrange(1, 9)}, and R&D pays * see note {self.rng.randrange(9)}.",
                f"See C:\\{self.word()}\\{self.word()} or C# and 2^{self.rng.randrange(99)} at most, says issue #{self.rng.randrange(99)}.",
            )
        return self.words(5, 16).capitalize() + f" {self.rng.randrange(3000)}" * (odd > 0.7) + "."

    def code(self) -> str:
        a, b, c, n = self.word(), self.word(), self.word(), self.rng.randrange(3000)
        line = self.pick(
            f"{a} = {b}.get({c}, {n})", f"if {a} > {n} or not {b}:", f"for {a}, {b} in {c}.items({n}):", f"let mut {a}: Vec<{b.title()}> = Vec::with_capacity({n});", f"assert!({a}.len() <= {n}, \"{b} {c}\");",
            f"const {a} = {b}.map((x) => x.{c} + {n});", f"for _, {a} := range {b} {{ {c} = append({c}, {a}.Get()) }}", f"{a}->{b} = {c}({n});", f"await {a}.push({{ {b}: {n}, {c} }});", f"raise {a.title()}(\"{b}: %s\" % {c})",
            f"switch {a} {{ case {n}: {b} = {c}; default: {a}++ }}", f"SELECT {a}, {b} FROM {c} WHERE {a} > {n};", f"if [ \"${a}\" -gt {n} ]; then {b}; fi", f"{a}[{b}] = {c} + {n}", f"{a} | {b} -n {n} > \"${c}\"", f"return {a} ? {b} : {n};",
            f"self.{a} = {b} or {c.title()}({n})", f"{a}::{b}(&mut {c}, {n})?;", f"def {a}({b}, {c}={n}):", f"}}", f"match {a}.{b}() {{ Some(e) => {c} += e, None => {a} = {n} }}",
        )
        return self.pick("", "", "  ", "    ") + line

    def sample(self) -> str:
        """A line within a fence, listing or <pre>: code, as a rule, and now and then markup that is shown."""
        a, n = self.word(), self.rng.randrange(300)
        if self.rng.random() < 0.55:
            return self.code()
        return self.pick(
            f"# {self.words(1, 5)}", f"## {self.words(1, 4)}", f"// {self.words(2, 6)}", f"if [[ -f {a}.txt ]]; then", f"echo {{{{ {a} }}}}", f"call({a}, **{self.word()})", f"- [ ] {self.words(2, 5)}", f"> {self.words(1, 5)}", f"{a}[{n}][{self.word()}]", f"$ {a} --{self.word()} {n}",
            f"--- {a}", f"| {a} | {n} |", f"|---|---|", self.inline(self.pick(*KINDS)), self.marked(self.pick(*KINDS)), f"=== {self.words(1, 3)} ===",  "'" * 3 + self.words(1, 3) + "'" * 3, f"\\item {self.words(1, 4)}", f"{a} = '<{self.pick('b', 'p', 'div', 'br')}>' + {self.word()}", f"{n} {a} {self.rng.randrange(99)} ms",
        )

    def inline(self, kind: str) -> str:
        w = self.words(1, 3)
        if kind == "html":
            return self.pick(f"<b>{w}</b>", f"<em>{w}</em>", f'<a href="/{self.word()}">{w}</a>', f'<span class="{self.word()}">{w}</span>', "&amp;", "&nbsp;&mdash; ", f"&lt;{w}&gt;", "<br>", "<br/>", f"<u>{w}</u>", f"<code>{w}</code>", f"<STRONG>{w}</STRONG>")
        if kind == "markdown":
            return self.pick(f"`{w}`", f"**{w}**", f"_{w}_", f"[{w}](./{self.word()}.md)", f"![{w}]({self.word()}.png)", f"*{w}*", f"~~{w}~~", f"[{w}][{self.rng.randrange(9)}]", f"_{w}_ and **{w}**")
        if kind == "wiki":
            return self.pick(f"[[{w}]]", f"[[{self.word()} page|{w}]]", f"'''{w}'''", f"''{w}''", f"{{{{note|{w}}}}}", f"{{{{{self.word()}|{self.rng.randrange(99)}}}}}")
        return self.pick(f"\\emph{{{w}}}", f"\\texttt{{{w}}}", f"$x_{{{self.rng.randrange(9)}}} \\le {self.rng.randrange(99)}$", f"$\\frac{{1}}{{k+{self.rng.randrange(99)}}}$", f"\\textbf{{{w}}}", f"page~\\ref{{sec:{self.word()}}}", f"\\cite{{{self.word()}}}")

    def marked(self, kind: str) -> str:
        s = " ".join(self.sentence() for _ in range(self.pick(1, 1, 1, 3, 6))).split(" ")
        at, piece = self.rng.randrange(1, max(2, len(s))), self.inline(kind)
        if kind == "html" and self.rng.random() < 0.4:  # touches the word before
            s[at - 1] += self.pick(piece, "<br/>", "<br>")
        else:
            s.insert(at, piece)
        return " ".join(s)

    def part(self, kind: str) -> list[tuple[str, list[str]]]:
        """Some lines of a document of this kind, each with its labels."""
        plain = lambda: (" ".join(self.sentence() for _ in range(self.pick(1, 1, 2, 4, 8))), [])
        code = [(self.code(), ["code"]) for _ in range(self.rng.randrange(2, 7))]
        shown = [(self.sample(), ["code"]) for _ in range(self.rng.randrange(1, 8))]
        title, roll = self.words(2, 6).capitalize(), self.rng.random()
        if roll < 0.25:
            return [plain() for _ in range(self.rng.randrange(1, 4))]
        if roll < 0.33:
            return [(self.pick("- ", "* ", "+ ", "1. ") + self.sentence(), []) for _ in range(self.rng.randrange(2, 5))]
        if kind == "none" or roll < 0.36:
            return code if roll < 0.55 else [(title, []), plain()]
        if roll < 0.6:
            return [((self.pick("", "", "- ", "* ") + self.marked(kind)), [kind]) for _ in range(self.rng.randrange(1, 4))]
        mark = [kind]
        if kind == "html":
            return self.pick(
                [(f"<h2>{title}</h2>", mark)], [("<ul>", mark), *((f"  <li>{self.sentence()}</li>", mark) for _ in range(3)), ("</ul>", mark)], [(f"<p>{self.sentence()}", mark), plain(), (f"{self.sentence()}</p>", mark)],
                [("<pre><code>" + self.code().replace("<", "&lt;"), ["html", "code"]), *code, ("</code></pre>", mark)], [(f"<!-- {self.words(1, 4)} {self.rng.randrange(99)} > {self.word()} -->", mark)],
                [('<table border="1">', mark), *((f"<tr><td>{self.word()}</td><td>{self.rng.randrange(999)}</td></tr>", mark) for _ in range(3)), ("</table>", mark)], [(f"<p align=left>{self.sentence()}<div>{self.sentence()}</div>", mark)], [(f"{self.sentence()}</{self.pick('p', 'td', 'li', 'div')}><{self.pick('p', 'li', 'td', 'div')}>{self.sentence()}", mark)],
                [(f"<li>{self.sentence()}<td>{self.sentence()}", mark)],
            )
        if kind == "markdown":
            tick = self.pick("```", "~~~")
            return self.pick(
                [("#" * self.rng.randrange(1, 5) + f" {title}", mark)], [(title, []), (self.pick("=", "-") * max(3, len(title)), mark)], [(tick + self.pick("", "python", "rust", "text", "sh", "console"), mark), *shown, (tick, mark)],
                [(f"| {self.word()} | {self.word()} |", mark), ("|---|:---|", mark), *((f"| {self.word()} | {self.rng.randrange(999)} |", mark) for _ in range(3))], [(f"- [{self.pick(' ', 'x')}] {self.sentence()}", mark) for _ in range(3)], [(f"> {self.sentence()}", mark)],
            )
        if kind == "wiki":
            eq = "=" * self.rng.randrange(2, 6)
            return self.pick([(f"{eq} {title} {eq}", mark)], [(f"** {self.marked(kind)}", mark), (f"* {self.sentence()}", [])], [('{| class="wikitable"', mark), ("|-", mark), (f"| {self.word()} || {self.rng.randrange(99)}", mark), ("|}", mark)], [(f"{{{{infobox|name={self.word()}|size={self.rng.randrange(99)}}}}}", mark)], [(f"{{{{code|{self.word()}}}}}", mark)])
        env, held = self.pick("itemize", "enumerate"), self.pick("verbatim", "lstlisting")
        return self.pick(
            [(self.pick("\\section{", "\\subsection{", "\\subsubsection{") + title + "}", mark)], [(f"\\begin{{{env}}}", mark), *((f"  \\item {self.sentence()}", mark) for _ in range(3)), (f"\\end{{{env}}}", mark)],
            [("\\[", mark), (f"s_{{1}} = \\sum_{{i=1}}^{{{self.rng.randrange(99)}}} \\frac{{1}}{{k + r_i}}", mark), ("\\]", mark)], [(f"\\begin{{{held}}}", mark), *shown, (f"\\end{{{held}}}", mark)],
        )

    def document(self) -> list[tuple[str, list[str]]]:
        kind, other = self.pick("none", *KINDS, *KINDS), self.pick(*KINDS)
        lines = [x for _ in range(self.rng.randrange(2, 6)) for x in self.part(kind)]
        if self.rng.random() < 0.25:  # a stray piece of another markup
            at = self.rng.randrange(0, len(lines) + 1)
            lines[at:at] = [(self.marked(other), [other])] if self.rng.random() < 0.6 else self.part(other)
        if self.rng.random() < 0.3:  # chunks begin and end anywhere
            lines = lines[self.rng.randrange(0, max(1, len(lines) // 2)) :]
        return lines


def trained(docs: int = TRAIN_DOCS, epochs: int = 10) -> Labeller:
    """A labeller trained on so many documents of the writer; the same on every call."""
    w = Writer(3)
    told = []
    for _ in range(docs):
        lines = w.document()
        found = leaves("\n".join(x for x, _ in lines))
        if len(found) == len(lines) and lines:
            told.append((vectors(found), np.array([[float(k in ls) for k in LABELS] for _, ls in lines], np.float32)))
    model = Labeller(INPUTS)
    model.train(told, epochs)
    return model


@lru_cache(maxsize=1)
def labeller(weights: str = WEIGHTS) -> Labeller:
    """The trained labeller. ``python -m siltstone.llm.markup`` trains it and writes its weights; without that file it is trained here."""
    if not os.path.exists(weights):
        return trained()
    model = Labeller(INPUTS)
    with np.load(weights) as stored:
        model.p = {k: stored[k].astype(np.float32) for k in model.p}
    return model


def label(model: Labeller, texts: list[str], batch: int = 256, states: list[str] | None = None) -> list[tuple[list[tuple[str, tuple[str, ...]]], np.ndarray]]:
    """Leaves of each text, read from its state on, and the probabilities of their labels. Texts of like length go through the network together."""
    found = [leaves(t, s or "") for t, s in zip(texts, states or [""] * len(texts), strict=True)]
    out: list = [(f, np.zeros((0, len(LABELS)), np.float32)) for f in found]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = max(1, min(batch, 40_000 // max(1, len(found[order[min(at + batch, len(order)) - 1]]))))
        own = order[at : at + n]
        at += len(own)
        x, mask, _ = padded([vectors(found[i]) for i in own])
        p = model.predict(x, mask)
        for k, i in enumerate(own):
            out[i] = (found[i], p[k, : len(found[i])])
    return out


# ---- kinds and clean text


def _is_code(path: tuple[str, ...], p: np.ndarray) -> bool:
    return "fence" in path or any(x in ("pre", "env:verbatim", "env:lstlisting") for x in path) or (p[4] >= CODE_SURE and p[:4].max() < 0.5)


def kinds_of(found: list[tuple[str, tuple[str, ...]]], p: np.ndarray, decide: float = DECIDE) -> list[str]:
    """Kinds that some leaf holds with a probability of at least ``decide``."""
    most = p[:, : len(KINDS)].max(0) if len(p) else np.zeros(len(KINDS))
    return sorted(k for k, q in zip(KINDS, most, strict=True) if q >= decide)


def _of_documents(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, text, state`` of the chunks of document files.

    Up to ``FEW`` document files their ids (8 bytes each) are broadcast, and no text is shuffled;
    beyond that both sides are shuffled by file, and AQE splits files of very many chunks. So it is
    with the states. Chunks without ``ord`` and ``start_line`` are read by themselves.
    """
    own = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(DOCUMENTS)).select("file_id").distinct()
    small = own.limit(FEW + 1).count() <= FEW
    placed = {"ord", "start_line"} <= set(chunks.columns)
    rows = spread(chunks.select("chunk_id", "file_id", "text", *(["ord", "start_line"] if placed else []))).join(F.broadcast(own) if small else own, "file_id", "left_semi")
    if not placed:
        return rows.select("chunk_id", "text", F.lit("").alias("state"))
    begun = seeds(rows)
    few = begun.limit(FEW + 1).count() <= FEW
    return rows.select("chunk_id", "text").join(F.broadcast(begun) if few else begun, "chunk_id", "left").select("chunk_id", "text", F.coalesce("state", F.lit("")).alias("state"))


def seeds(rows: DataFrame) -> DataFrame:
    """``chunk_id, state`` of the chunks that begin with something open, from all chunks of their files by ``ord``.

    A chunk's signs are some bytes. ``BUCKET`` chunks are a group, whatever their file's length; the
    groups of a longer file are followed by their effects alone, one row each.
    """

    def gather(batches):
        for b in batches:
            found = [holds(t or "") for t in b.column("text").to_pylist()]
            at = pa.array([[n for n, _ in x] for x in found], pa.list_(pa.int32()))
            sign = pa.array([[s for _, s in x] for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("chunk_id", "file_id", "ord", "start_line")), at, sign], ["chunk_id", "file_id", "ord", "start_line", "at", "sign"])

    told = rows.where("ord is not null and start_line is not null").select("chunk_id", "file_id", F.col("ord").cast("long"), F.col("start_line").cast("long"), "text").mapInArrow(gather, "chunk_id long, file_id long, ord long, start_line long, at array<int>, sign array<string>")
    bucket = F.floor(F.col("ord") / BUCKET)
    # the first chunk of a bucket also ends the one before
    both = F.when((F.col("ord") % BUCKET == 0) & (F.col("ord") > 0), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    told = told.withColumn("bucket", F.explode(both))
    groups = told.groupBy("file_id", "bucket").agg(F.sort_array(F.collect_list(F.struct("ord", "start_line", "chunk_id", "at", "sign"))).alias("rows"), F.max(F.size("sign")).alias("signs"))
    groups = stage(groups.select("file_id", "bucket", "rows", "signs"), "holds")

    def ordered(rows, bucket):
        kept = []
        for r in rows:
            if not kept or r["chunk_id"] != kept[-1]["chunk_id"]:  # repeated rows
                kept.append(r)
        signs = own_signs(kept)
        return [(r, x) for r, x in zip(kept, signs, strict=True) if r["ord"] // BUCKET == bucket]

    def sum_up(batches):
        for b in batches:
            done = [json.dumps(effect([s for _, x in ordered(r, k) for s in x])) for r, k in zip(b.column("rows").to_pylist(), b.column("bucket").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("bucket"), pa.array(done, pa.string())], ["file_id", "bucket", "done"])

    def carry(batches):
        for b in batches:
            out = []
            for file, buckets in zip(b.column("file_id").to_pylist(), b.column("buckets").to_pylist(), strict=True):
                state = ""
                for x in buckets:
                    out.append((file, x["bucket"], state))
                    state = apply(json.loads(x["done"]), state)
            out = [x for x in out if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["file_id", "bucket", "carried"])

    def follow(batches):
        for b in batches:
            ids, states = [], []
            for rows, k, state in zip(b.column("rows").to_pylist(), b.column("bucket").to_pylist(), b.column("carried").to_pylist(), strict=True):
                for r, x in ordered(rows, k):
                    if state:
                        ids.append(r["chunk_id"])
                        states.append(state)
                    state = advance(state or "", x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(states, pa.string())], ["chunk_id", "state"])

    long = groups.join(groups.where("bucket > 0").select("file_id").distinct(), "file_id", "left_semi").select("rows", "file_id", "bucket")
    effects = long.mapInArrow(sum_up, "file_id long, bucket long, done string")
    carried = effects.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "done"))).alias("buckets")).mapInArrow(carry, "file_id long, bucket long, carried string")
    begun = groups.join(carried, ["file_id", "bucket"], "left").where("signs > 0 or carried is not null").select("rows", "bucket", "carried").mapInArrow(follow, "chunk_id long, state string")
    return stage(begun.distinct(), "begun")


def chunk_kinds(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, kind`` for each kind of markup that a chunk of a document file shows.

    Null and empty texts show none; chunks of files that aren't recorded are of no document file.
    Repeated rows come out once. The file ids of documents are the smaller side of the join.
    """
    model = labeller()

    def find(batches):
        for b in batches:
            ids, kinds = [], []
            for i, (found, p) in zip(b.column("chunk_id").to_pylist(), label(model, [t or "" for t in b.column("text").to_pylist()], states=b.column("state").to_pylist()), strict=True):
                for k in kinds_of(found, p):
                    ids.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["chunk_id", "kind"])

    rows = _of_documents(files, chunks.where("text is not null"))
    return rows.mapInArrow(find, "chunk_id long, kind string").distinct()


_INLINE = {
    "html": lambda s: html_entities.unescape(re.sub(r"<!--.*?(?:-->|$)|^.*?-->(?!.*<!--)", "", re.sub(r"<br\s*/?>", "\n", _TAG.sub(lambda m: "\t" if m.group(2).lower() in ("td", "th") and m.group(1) else m.group() if m.group(2).lower() == "br" else "", s), flags=re.I))).replace("\xa0", " "),
    "markdown": lambda s: re.sub(r"(?<![\w_])_(?=[^\s_])([^_\n]*[^\s_])_(?!\w)", r"\1", re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", re.sub(r"!?\[([^\[\]\n]+)\](?:\([^()\s]+(?:\s+\"[^\"]*\")?\)|\[[^\[\]\n]*\])", r"\1", s))),
    "wiki": lambda s: re.sub(r"\{\{(?:[^{}|]*\|)?([^{}]*)\}\}", lambda m: m.group(1).split("|")[-1], re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", re.sub(r"'{2,3}", "", s))),
    "latex": lambda s: re.sub(r"~?\\(?:ref|cite|label)\{[^}]*\}", "", re.sub(r"\\(?:emph|text\w+|underline|url|footnote)\{([^{}]*)\}", r"\1", s)).replace("~", " "),
}


def clean(found: list[tuple[str, tuple[str, ...]]], p: np.ndarray, decide: float = DECIDE) -> str:
    """Text without markup that keeps headings (``# ``), lists (``- ``), code (fenced) and formulas (``$``).

    Blank lines of the source aren't kept; blocks of code are set off by fences, whatever marked them.
    """
    out: list[str] = []
    coding = False

    def fence(on: bool) -> None:
        nonlocal coding
        if on != coding:
            out.append("```")
            coding = on

    for i, (line, path) in enumerate(found):
        if "fence-start" in path or "fence-end" in path:
            continue
        opens = bool(_PRE_OPENS.search(line)) and "fence" not in path
        if opens or _is_code(path, p[i]):
            inner = "fence" in path
            text = line if inner else re.sub(r"</?(?:pre|code)\b[^>]*>", "", line, flags=re.I)
            text = html_entities.unescape(text) if not inner and (opens or "pre" in path) else text
            if re.match(r"^\s*\\end\{", text) or not text.strip():
                continue
            fence(True)
            out.append(text)
            continue
        fence(False)
        kinds = [k for j, k in enumerate(KINDS) if p[i, j] >= decide and (SIGNS[k].search(line) or (k == "markdown" and (_SETEXT.match(line) or _SPAN.search(line))))]
        level, text = 0, line.strip()
        if "html" in kinds:
            if m := re.search(r"<h([1-6])\b", text, re.I):
                level = int(m.group(1))
            bullet = re.search(r"<li\b", text, re.I)
            text = re.sub(r"</(?:p|div|li|tr|h[1-6]|ul|ol)>(?=.)", "\n", text, flags=re.I)
            text = ("- " if bullet else "") + _INLINE["html"](text).strip()
        if "markdown" in kinds:
            if i and out and _SETEXT.match(text):
                out[-1] = ("# " if text[0] == "=" else "## ") + out[-1]
                continue
            if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", text):
                level, text = len(m.group(1)), m.group(2)
            if re.match(r"^\|?\s*:?-{2,}:?\s*\|", text):
                continue
            if text.startswith("|"):
                text = "\t".join(c.strip() for c in text.strip("|").split("|"))
            text = re.sub(r"^([-*+]) \[[ xX]\] ", "- ", re.sub(r"^> ?", "", text))
            text = "".join(s if k % 2 else _INLINE["markdown"](s) for k, s in enumerate(re.split(r"(`+[^`]+`+)", text)))
            text = re.sub(r"`+([^`]+)`+", r"\1", text)
        if "wiki" in kinds:
            if m := re.match(r"^(={2,6})\s*(.*?)\s*\1$", text):
                level, text = len(m.group(1)), m.group(2)
            if re.match(r"^(?:\{\||\|\}|\|-)", text):
                continue
            if text.startswith("|"):
                text = "\t".join(c.strip() for c in re.split(r"\|\|", text.lstrip("|")))
            text = _INLINE["wiki"](text)
        if "latex" in kinds:
            if m := re.match(r"^\\((?:sub)*)(?:section|chapter|paragraph)\*?\{(.*)\}$", text):
                level, text = 1 + len(m.group(1)) // 3, m.group(2)
            if re.match(r"^\\(?:begin|end)\{", text) or re.match(r"^\\(?:maketitle|noindent|centering|hline|tableofcontents|label\{[^}]*\})\s*$", text):
                continue
            if text in ("\\[", "\\]"):
                out.append("$$")
                continue
            text = "".join(s if k % 2 else _INLINE["latex"](s) for k, s in enumerate(re.split(r"(\$[^$\n]+\$)", re.sub(r"^\\item\s*", "- ", text))))
        if not text.strip():
            continue
        text = re.sub(r"^(\*+|\++)(?=\s)", "-", text)
        out.append("#" * level + " " + text if level else text)
    fence(False)
    return "\n".join(out)


def clean_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, text`` of the chunks of document files as clean text; null texts stay null."""
    model = labeller()

    def work(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            done = [None if t is None else clean(*x) for t, x in zip(texts, label(model, [t or "" for t in texts], states=b.column("state").to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(done, pa.string())], ["chunk_id", "text"])

    rows = _of_documents(files, chunks)
    return rows.mapInArrow(work, "chunk_id long, text string")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **trained().p)
