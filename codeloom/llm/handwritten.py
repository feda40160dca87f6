"""Files nobody wrote by hand: generated, minified, vendored, or data kept as code.

Files are cut into tokens and grammars are inferred from the token sequences by pair
replacement. A rule's name is a hash of what it expands to, so equal rules have equal names
in all files and tasks.

* Rule reuse. Re-Pair over the kinds of tokens: rounds count the adjacent pairs of every file
  and replace, all at once, those that occur more often than the pairs that overlap them,
  until no pair occurs twice. One rule that is used very often and covers nearly all of a
  file says generated by itself; less reuse needs the word of a head comment or a path.
* Bare literals. Re-Pair over a file's literals alone: literals that end up in no rule can't be
  compressed. If they are most of a code file, it holds data.
* Shared rules. Across files, which pair is replaced is decided by the symbols themselves
  instead of by counts, since counting the pairs of all files would take a shuffle for each
  round: a symbol hashes to a left or a right hand, and a left one joins a right one behind it.
  Equal stretches of text get equal rules in every file. Rules that several repositories
  share, one of whose files is a known package or says that it is third-party, and rules
  that three repositories share over nearly all of a long file, say vendored.
* Tokens without white space on few long lines with one-letter names: minified.

Paths and head comments never make a file generated or data without the grammar's evidence.
They do decide where there is nothing to measure: lock files and source maps are named, and a
third-party file that only one repository has shares no rule with anyone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import relative_posix
from codeloom.session import kept, spread

# Suffixes of source code, and names of lock files.
CODE = ("py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "java", "go", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "rs", "kt", "scala", "swift", "css", "scss", "lua", "pl", "m", "dart")
LOCKS = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "pdm.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "go.work.sum", "packages.lock.json", "gradle.lockfile", "flake.lock", "mix.lock", "pubspec.lock", "bun.lockb", "deno.lock")
# What paths say.
_CODE_SUFFIX = r"(?i)\.(?:" + "|".join(CODE) + r")$"
LOCK_PATH = r"(?:^|/)(?:" + "|".join(re.escape(x) for x in LOCKS) + r")$"
MAP_PATH = r"(?i)\.(?:js|mjs|cjs|css|ts)\.map$"
MINIFIED_PATH = r"(?i)(?:[.\-]min\.(?:js|mjs|css)|\.(?:bundle|chunk)\.(?:js|mjs|css)|[-.][0-9a-f]{8,20}\.(?:bundle\.|chunk\.)?(?:js|css))$"
VENDOR_PATH = r"(?:^|/)(?:node_modules|bower_components|site-packages|dist-packages|jspm_packages|_vendor|vendored|third[_\-]?party|3rdparty|Pods|Carthage|Godeps)/.+|(?:^|/)(?:vendor|external|extern|externals|deps|thirdparty)/[^/]+/.+"
GENERATED_PATH = (
    r"(?:(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|gw\.go)|_grpc\.pb\.go|\.(?:gen|generated|g)\.(?:ts|tsx|js|go|py|java|cs|dart)|OuterClass\.java|\.designer\.cs|_generated\.(?:go|py|rs|ts|js|h|java))$"
    r"|(?:^|/)zz_generated[._][^/]+$|(?:^|/)(?:__generated__|_generated|generated-sources|generated-src|autogen|gen)/[^/]*\.\w+$|(?:^|/)generated-sources/.+)"
)
_TEST_PATH = r"(?:^|/)(?:test_[^/]+|[^/]+_test\.\w+)$"
# Comments at the head of files that tools wrote, and of third-party files.
_MARKER = re.compile(
    r"(?i)\b(?:code|file|source|this file|stubs?|bindings?|client) (?:is |was |has been )?(?:auto(?:matically)?[ -]?)?generated\b(?!.*\b(?:elsewhere|lives)\b)|\bauto-?generated\b|@generated\b|automatically (?:created|generated)|generad[oa] autom|automatisch (?:erzeugt|generiert|erstellt)|généré(?:e)? (?:automatiquement|par)|gerado automaticamente|generato automaticamente|machine[- ]generated|\bdo not (?:edit|modify)\b.*\bgenerat"
)
_DENIAL = re.compile(r"(?i)\b(?:not|never|isn't|aren't|no longer) (?:auto-?)?generated|by hand|elsewhere")
_THIRD = re.compile(
    r"(?i)\bthis file is part of [\w.\-]+ v?\d+(?:\.\d+)+|^[\w.\-]+ - release v?\d+(?:\.\d+)+|^[\w.\-]+ v?\d+(?:\.\d+)+ ?[|,-] ?(?:\(c\)|copyright)|\bdistributed under the terms of the \w+ licen[cs]e|@license\b|\bmit licensed\b|\blicensed under the (?:mit|bsd|apache)[^.]*\bauthors\b"
)
_COMMENT_HEAD = re.compile(r"(?:\s|﻿|#![^\n]*\n|#[^\n]*(?:\n|$)|//[^\n]*(?:\n|$)|/\*.*?\*/|<!--.*?-->|--[^\n]*(?:\n|$)|'use strict';|\"use strict\";|package [\w.]+;?\s*\n)*", re.S)

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c == 95 or _c >= 128:
        _WORD[_c] = 1
    elif _c in (9, 11, 12, 13, 32):
        _WORD[_c] = 2
    elif _c == 10:
        _WORD[_c] = 3
_KIND = np.zeros(256, np.uint8)  # letter case and digits, for the ups and downs inside a word
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _tokens(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of files laid end to end; ``starts`` has the first byte of each file and the end.

    A token is a run of word bytes or one other byte that isn't white space.
    """
    n = len(data)
    cls = _WORD[data]
    word = cls == 1
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~(word[1:] & word[:-1])
    first[starts[:-1][starts[:-1] < n]] = True
    first &= (cls == 1) | (cls == 0)
    at = np.flatnonzero(first)
    is_word = word[at]
    # End of each token: the next byte that isn't a word byte, or the next file.
    stop = ~word
    stop[starts[:-1][starts[:-1] < n]] |= True
    ends = np.append(np.flatnonzero(stop), n)
    end = np.where(is_word, ends[np.minimum(np.searchsorted(ends, at + 1), len(ends) - 1)], at + 1)
    length = (end - at).astype(np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,))
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(length, 8).astype(np.uint64)))
    head = eight[at] & keep
    tail = eight[np.maximum(end - 8, at)] & np.where(length < 8, keep, np.uint64(0xFFFFFFFFFFFFFFFF))
    name = _mix(head + _M3 * _mix(tail ^ (length.astype(np.uint64) << np.uint64(56))))
    return {"at": at, "length": length, "word": is_word, "name": name, "file": (np.searchsorted(starts, at, side="right") - 1).astype(np.int64)}


def repair(symbols: np.ndarray, file: np.ndarray, n_files: int, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Re-Pair of many sequences at once, until no pair occurs twice.

    Returns, per sequence: its length, the length after all rounds, the greatest share of it
    that one rule of at least three symbols covers with at least four uses, those uses, and
    the ``weight`` of the symbols that no rule covers.
    """
    size = np.bincount(file, minlength=n_files).astype(np.int64)
    sym, fid = symbols.astype(np.uint64), file
    length = np.ones(len(sym), np.int64)
    bare = np.ones(len(sym)) if weight is None else weight.astype(np.float64)  # 0 in rules
    share, uses = np.zeros(n_files), np.zeros(n_files, np.int64)
    while len(sym) > 1:
        same = fid[1:] == fid[:-1]
        rule = _mix(sym[:-1] * _M1 + sym[1:] * _M3)
        _, inverse, counts = np.unique(rule ^ _mix(fid[:-1].astype(np.uint64) + _M2), return_inverse=True, return_counts=True)
        count = np.where(same, counts[inverse], 0)
        left = np.concatenate([[0], count[:-1]])
        right = np.concatenate([count[1:], [0]])
        take = (count >= 2) & (count >= left) & (count >= right)
        if not take.any():
            break
        # Of overlapping pairs that are equally frequent, every other one.
        begin = take & ~np.concatenate([[False], take[:-1]])
        run = np.cumsum(begin)
        offset = np.arange(len(take)) - np.flatnonzero(begin)[np.maximum(run - 1, 0)]
        take &= offset % 2 == 0
        i = np.flatnonzero(take)
        sym, length, bare = sym.copy(), length.copy(), bare.copy()
        sym[i] = rule[i]
        length[i] += length[i + 1]
        bare[i] = 0
        # How much of its file each new rule covers.
        used = _mix(rule[i] ^ _mix(fid[i].astype(np.uint64)))
        _, where, inv, times = np.unique(used, return_index=True, return_inverse=True, return_counts=True)
        f, cover = fid[i][where], np.bincount(inv, weights=length[i]) / np.maximum(size[fid[i][where]], 1)
        good = (times >= 4) & (length[i][where] >= 3)
        order = np.argsort(cover[good], kind="stable")
        f, cover, times = f[good][order], cover[good][order], times[good][order]
        better = cover > share[f]
        uses[f[better]] = times[better]
        np.maximum.at(share, f, cover)
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, fid, length, bare = sym[keep], fid[keep], length[keep], bare[keep]
    return {"size": size, "left": np.bincount(fid, minlength=n_files), "share": share, "uses": uses, "bare": np.bincount(fid, weights=bare, minlength=n_files)}


def shared_rules(symbols: np.ndarray, file: np.ndarray, rounds: int = 12, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, file, tokens) of the rules of at least ``least`` tokens after ``rounds`` rounds of pairing by content.

    A round shortens a sequence by about a quarter, so rules have some thirty tokens. The
    number of rounds sets that length and has nothing to do with the length of a file.
    """
    sym, fid = symbols.astype(np.uint64), file
    length = np.ones(len(sym), np.int64)
    for r in range(rounds):
        hand = (_mix(sym ^ np.uint64(r + 1)) >> np.uint64(7)) & np.uint64(1)
        i = np.flatnonzero((fid[1:] == fid[:-1]) & (hand[:-1] == 0) & (hand[1:] == 1))
        sym, length = sym.copy(), length.copy()
        sym[i] = _mix(sym[i] * _M1 + sym[i + 1] * _M3)
        length[i] += length[i + 1]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, fid, length = sym[keep], fid[keep], length[keep]
    long = length >= least
    return sym[long].astype(np.int64), fid[long], length[long]


def _features(texts: list[str]) -> dict[str, list]:
    blobs = [t.encode("utf-8", "replace") for t in texts]
    n = len(blobs)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    if not len(data):
        zero = [0.0] * n
        return {"n_tokens": [0] * n, "left": [0] * n, "share": zero, "uses": [0] * n, "bare": zero, "blank": zero, "name_length": zero, "line_length": [0] * n, "rules": [[] for _ in range(n)], "weights": [[] for _ in range(n)]}
    t = _tokens(data, starts)
    file, at, length, is_word, name = t["file"], t["at"], t["length"], t["word"], t["name"]
    digit = is_word & (_KIND[data[at]] == 3)
    abstract = np.where(digit, 2, np.where(is_word, 1, data[at].astype(np.int64) + 256)).astype(np.uint64)
    g = repair(abstract, file, n)

    # Literals: numbers, and words whose letters and digits go up and down as in random text.
    kinds = _KIND[data]
    turn = np.zeros(len(data) + 1, np.int64)
    turn[1:-1] = np.cumsum((kinds[1:] != kinds[:-1]) & (_WORD[data[1:]] == 1) & (_WORD[data[:-1]] == 1))
    turn[-1] = turn[-2]
    turns = turn[np.minimum(at + length - 1, len(data) - 1)] - turn[at]
    literal = digit | (is_word & (length >= 8) & (turns >= 0.28 * length))
    word_bytes = np.maximum(np.bincount(file, weights=length * is_word, minlength=n), 1)
    bare = repair(name[literal], file[literal], n, length[literal])["bare"] / word_bytes

    names = is_word & ~digit
    name_length = np.bincount(file, weights=length * names, minlength=n) / np.maximum(np.bincount(file, weights=names, minlength=n), 1)
    blank = np.bincount(np.searchsorted(starts, np.flatnonzero(_WORD[data] >= 2), side="right") - 1, minlength=n) / np.maximum(np.diff(starts), 1)
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, starts]))
    width = np.diff(cuts)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.searchsorted(starts, cuts[:-1], side="right") - 1, width)

    rules, weights = [[] for _ in range(n)], [[] for _ in range(n)]
    for r, f, w in zip(*(a.tolist() for a in shared_rules(name, file)), strict=True):
        rules[f].append(r)
        weights[f].append(w)
    return {
        "n_tokens": g["size"].tolist(), "left": g["left"].tolist(), "share": g["share"].tolist(), "uses": g["uses"].tolist(), "bare": bare.tolist(),
        "blank": blank.tolist(), "name_length": name_length.tolist(), "line_length": longest.tolist(), "rules": rules, "weights": weights,
    }


def head_says(text: str) -> tuple[bool, bool]:
    """(written by a tool, third party), as the comments before the first code say."""
    head = _COMMENT_HEAD.match(text)[0]
    if not head.strip():
        return False, False
    lines = [re.sub(r"^\s*(?:#+!?|//+!?|/?\*+!?|--|<!--)\s*|\s*\*/\s*$", "", x) for x in head.split("\n")]
    tool = any(_MARKER.search(x) and not _DENIAL.search(x) for x in lines)
    return tool, any(_THIRD.search(x) for x in lines)


_FIELDS = [("n_tokens", pa.int64()), ("left", pa.int64()), ("share", pa.float64()), ("uses", pa.int64()), ("bare", pa.float64()), ("blank", pa.float64()), ("name_length", pa.float64()), ("line_length", pa.int64()), ("rules", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))]
FEATURES = "payload_id bigint, project_root string, path string, sha string, n_tokens bigint, left bigint, share double, uses bigint, bare double, blank double, name_length double, line_length bigint, rules array<bigint>, weights array<bigint>, tool boolean, third boolean, lock boolean"
_SLICE = 2_000_000  # characters of text handled at once


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or "" for x in b.column(4).to_pylist()]
        done = 0
        while done < len(texts):
            size, end = 0, done
            while end < len(texts) and (end == done or size + len(texts[end]) <= _SLICE):
                size += len(texts[end])
                end += 1
            part = texts[done:end]
            f = _features(part)
            heads = [head_says(x) for x in part]
            columns = [b.column(k).slice(done, end - done) for k in range(4)]
            columns += [pa.array(f[name], kind) for name, kind in _FIELDS]
            columns += [pa.array([h[0] for h in heads], pa.bool_()), pa.array([h[1] for h in heads], pa.bool_()), pa.array(['"lockfileVersion"' in x for x in part], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["payload_id", "project_root", "path", "sha", *[x for x, _ in _FIELDS], "tool", "third", "lock"])
            done = end


def file_features(df: DataFrame) -> DataFrame:
    """``FEATURES`` of every file: grammar measures, rules that files may share, and what the head says. Null content is an empty text. No shuffle."""
    rows = df.select(
        F.col("payload_id").cast("bigint").alias("payload_id"),
        F.col("project_root").cast("string").alias("project_root"),
        relative_posix(F.col("path"), F.col("project_root")).alias("path"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha"),
        F.col("content").cast("string").alias("content"),
    )
    return spread(rows, "payload_id").mapInArrow(_run, FEATURES)


def path_verdict(path: Column) -> Column:
    """What the path alone says: lock, map, minified, vendored, generated or null."""
    code = path.rlike(_CODE_SUFFIX)
    return (
        F.when(path.rlike(LOCK_PATH), "lock")
        .when(path.rlike(MAP_PATH), "map")
        .when(~code, None)
        .when(path.rlike(VENDOR_PATH), "vendored")
        .when(path.rlike(MINIFIED_PATH), "minified")
        .when(path.rlike(GENERATED_PATH) & ~path.rlike(_TEST_PATH), "generated")
    )


def shared_cover(features: DataFrame, salt: int = 16) -> DataFrame:
    """``row, third_cover, common_cover``: tokens of each file in rules of third-party files, and in rules of three repositories.

    A rule is third-party's if at least two repositories have it and any file with it is
    ``anchor``, however many copies aren't. Holders are folded by rule and repository before
    they are counted; a rule that a third of all files have is joined in ``salt`` parts.
    """
    pairs = features.select("row", F.coalesce("project_root", F.lit("")).alias("root"), "anchor", F.inline(F.arrays_zip("rules", "weights")))
    by_root = pairs.groupBy("rules", "root").agg(F.bool_or("anchor").alias("anchor"))
    rules = by_root.groupBy("rules").agg(F.bool_or("anchor").alias("_third"), F.count(F.lit(1)).alias("_roots")).where((F.col("_roots") >= 3) | (F.col("_third") & (F.col("_roots") >= 2)))
    parts = rules.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    held = pairs.select("row", "rules", "weights", F.pmod(F.xxhash64("row"), F.lit(salt)).cast("int").alias("_s")).join(parts, ["rules", "_s"])
    return held.groupBy("row").agg(F.sum(F.when(F.col("_third"), F.col("weights")).otherwise(0)).alias("third_cover"), F.sum(F.when(F.col("_roots") >= 3, F.col("weights")).otherwise(0)).alias("common_cover"))


def classified_files(df: DataFrame, known: DataFrame, trust_marks: bool = True) -> DataFrame:
    """``payload_id, project_root, path, verdict, share, uses, bare, shared``; verdict is null for hand-written files.

    ``known``: digests of third-party files (``sha256``). Null paths, roots and contents are
    allowed: such files are judged by what is there. Empty files are hand-written unless the
    path says otherwise. Repeated rows count each for itself. ``trust_marks=False`` leaves
    head comments and paths out, so that only suffixes, digests and the grammars decide.
    """
    # A table in the shared folder: the measures are used three times, the files are read once.
    f = kept(file_features(df).withColumn("row", F.monotonically_increasing_id()))
    digests = known.select(F.lower("sha256").alias("sha")).where("sha IS NOT NULL").distinct().withColumn("known", F.lit(True))
    f = f.join(digests, "sha", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if trust_marks:
        f = f.withColumn("says", path_verdict(F.col("path")))
    else:
        f = f.withColumns({"says": F.lit(None).cast("string"), "tool": F.lit(False), "third": F.lit(False), "lock": F.lit(False)})
    f = f.withColumn("anchor", F.col("known") | F.col("third") | F.coalesce(F.col("says") == "vendored", F.lit(False)))
    j = f.join(shared_cover(f), "row", "left")
    share_of = lambda c: F.coalesce(F.col(c) / F.greatest("n_tokens", F.lit(1)), F.lit(0.0))
    code = F.col("path").rlike(_CODE_SUFFIX)
    script = F.col("path").rlike(r"(?i)\.(?:js|mjs|cjs|jsx|ts|tsx|css)$")
    minified = script & (F.col("n_tokens") >= 40) & (F.col("blank") < 0.08) & (F.col("name_length") < 4.5) & (F.col("line_length") >= 200)
    told = F.col("tool") | F.coalesce(F.col("says") == "generated", F.lit(False))
    generated = code & (((F.col("share") >= 0.9) & (F.col("uses") >= 16)) | (told & (F.col("left") <= 0.8 * F.col("n_tokens"))))
    data = code & (F.col("bare") >= 0.7) & ((F.col("n_tokens") >= 40) | (F.col("line_length") >= 200))
    long = F.col("n_tokens") >= 150
    copied = code & ((share_of("third_cover") >= F.when(long, 0.7).otherwise(0.85)) | ((share_of("common_cover") >= 0.9) & long))
    verdict = (
        F.when(F.col("says").isin("lock", "map"), F.col("says"))
        .when(F.col("lock") & F.col("path").rlike(r"(?i)\.json$"), "lock")
        .when(F.col("known"), "vendored")
        .when(copied, "vendored")
        .when(code & (F.col("third") | (F.col("says") == "vendored")), "vendored")
        .when(minified | (F.col("says") == "minified"), "minified")
        .when(data & ~told, "data")
        .when(generated, "generated")
    )
    return j.select("payload_id", "project_root", "path", verdict.alias("verdict"), "share", "uses", "bare", F.greatest(share_of("third_cover"), share_of("common_cover")).alias("shared"))


def classified_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``entry_id, verdict`` of manifest entries that nobody wrote by hand.

    An entry takes the verdict of the files with its project and path; without such a file
    the path decides. Paths are compared in relative POSIX form. Null paths match nothing.
    """
    e = entries.select(F.col("entry_id").cast("bigint").alias("entry_id"), "project_root", relative_posix(F.col("path"), F.col("project_root")).alias("path"))
    by_path = files.where("path IS NOT NULL AND project_root IS NOT NULL").groupBy("project_root", "path").agg(F.min("verdict").alias("verdict"), F.lit(True).alias("there"))
    return (
        e.join(by_path, ["project_root", "path"], "left")
        .select("entry_id", F.when(F.col("there"), F.col("verdict")).otherwise(path_verdict(F.col("path"))).alias("verdict"))
        .where("verdict IS NOT NULL")
    )
