"""The whole licence query against plain Python: frequencies, blocks, cosines, shares and inheritance."""

from __future__ import annotations

import math
from collections import Counter

import regex

from bytestrata.llm import licenses, queries
from tests.llm.test_licenses import HEADERS

CUE, COMMENT = regex.compile(licenses.CUE), licenses.COMMENT


def words(text: str) -> int:
    return len(regex.findall(r"[^\x20\x09-\x0D]+", text))


def blocks(text: str) -> list[str]:
    text = regex.sub(r"(?m)^[^\p{L}\p{N}\n]*$", "", text)
    apart = regex.sub(rf"(?m)^({COMMENT}[^\n]*)\n(?!{COMMENT})", r"\1\n\n", text)
    apart = regex.sub(rf"(?m)^((?!{COMMENT})[^\n]+)\n(?={COMMENT})", r"\1\n\n", apart)
    out: list[str] = []
    for parts in (text.split("\n"), regex.split(r"\n{2,}", text), regex.split(r"\n{2,}", apart)):
        own = [p for p in parts if CUE.search(p)]
        out += [x for x in [*own, "\n".join(own)] if x not in out]
    return out


def best(texts: list[str], templates: tuple, idf: dict[str, float], unseen: float) -> tuple | None:
    """(score, name, place of the text) of the closest, the first of equals."""
    vectors = [{t: c * idf[t] for t, c in Counter(licenses.terms(text)).items()} for _, text in templates]
    known = {t for v in vectors for t in v}
    found = None
    for k, text in enumerate(texts):
        own = {t: c * (idf[t] if t in known else unseen) for t, c in Counter(licenses.terms(text)).items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        for i, v in enumerate(vectors) if length else ():
            score = sum(x * v[t] for t, x in own.items() if t in v) / length / math.sqrt(sum(x * x for x in v.values()))
            if found is None or score > found[0] + 1e-12:
                found = score, templates[i][0], k
    return found


def scanned(files: list[tuple]) -> dict:
    every = licenses.TEMPLATES + licenses.TEXTS
    vocabulary = {t for _, text in every for t in licenses.terms(text)}
    n, df = len(files), Counter(t for _, _, text in files for t in set(licenses.terms(text or "")) & vocabulary)
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    unseen, own = math.log(n + 1) + 1, {}
    for doc, path, text in files:
        text, license_, score, share = text or "", None, None, 0.0
        if CUE.search(text):
            parts = blocks(text)
            block, whole = best(parts, licenses.TEMPLATES, idf, unseen), best([text], licenses.TEXTS, idf, unseen)
            if whole and whole[0] >= licenses.TEXT_THRESHOLD:
                score, license_, share = whole[0], whole[1], 1.0
            elif block and block[0] >= licenses.THRESHOLD:
                cued = "\n".join(line for line in text.split("\n") if CUE.search(line))
                score, license_, share = block[0], block[1], max(words(cued), words(parts[block[2]])) / words(text)
        own[doc] = path, license_, score, share
    said: dict = {}
    for path, license_, score, share in own.values():
        if license_ and (share >= licenses.FILE_SHARE or regex.search(licenses.FILE_NAME, path)):
            folder = path.rpartition("/")[0]
            said.setdefault(folder, []).append((-score, path, license_))
    out = {}
    for doc, (path, license_, score, _) in own.items():
        origin, where, folder = ("header", path, "") if license_ else (None, None, path.rpartition("/")[0])
        while not license_:
            if folder in said:
                least, where, license_ = min(said[folder])
                score, origin = -least, "directory"
                break
            if "/" not in folder:
                break
            folder = folder.rpartition("/")[0]
        out[doc] = license_, None if score is None else round(score, 6), origin, where
    return out


def test_license_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    files = [(r["doc_id"], r["path"], r["text"]) for r in licenses.document_files(docs).collect()]
    got = {r["doc_id"]: (r["license"], None if r["score"] is None else round(r["score"], 6), r["origin"], r["license_path"]) for r in queries.QUERIES["op7_licenses"](spark, tables).collect()}
    want = scanned(files)
    assert got == want and any(w[2] == "header" for w in want.values())


def test_licenses_of_made_files(spark):
    prose = "Some words of prose about nothing at all, said twice. " * 5
    files = [(i, f"/src/p{i}/code.c", text) for i, (_, text) in enumerate(HEADERS)]
    files += [(100 + i, f"/lib/{name}/LICENSE.txt", text) for i, (name, text) in enumerate(licenses.TEXTS)]
    files += [(200 + i, f"/lib/{name}/deep/er/file.txt", prose) for i, (name, _) in enumerate(licenses.TEXTS)]
    files += [(300, "/src/p0/other.c", prose), (301, "/none.txt", prose), (302, "/src/p1/notice.c", "All rights reserved.\n\n" + prose), (303, "/lib/x.txt", ""), (304, "/lib/y.txt", None)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], None if r["score"] is None else round(r["score"], 6), r["origin"], r["license_path"]) for r in licenses.scan(df).collect()}
    want = scanned(files)
    assert got == want
    assert all(want[200 + i][0] == name for i, (name, _) in enumerate(licenses.TEXTS))
