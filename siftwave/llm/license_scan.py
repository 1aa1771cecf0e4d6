"""License scans: a positional index of rare template words, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.llm.storage import fold_ascii, let, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text and the phrases that a match must contain, all in lower-case words."""

    label: str
    text: str
    keys: tuple[str, ...]
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(self.text.split()))

    def key_places(self) -> list[tuple[int, tuple[str, ...]]]:
        out = []
        for key in self.keys:
            k = tuple(key.split())
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k))
        return out


BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The public wording of licences and of the notices that name them, as lower-case words.
_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised "
    "of the possibility of such damage"
)
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation either version {} of the license or at your option any later version"
TEMPLATES = (
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software "
        "is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense", "this permission notice shall be included"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    *[Template(f"{label}-{v}.0-notice", " ".join(_GNU.format(kind, v).split()), (" ".join(f"gnu {kind} general public license".split()), f"either version {v} of the license")) for label, kind, v in (("gpl", "", 2), ("gpl", "", 3), ("lgpl", "lesser", 3), ("agpl", "affero", 3))],
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0-notice", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa-4.0-notice", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("nor the names of its contributors may be used to endorse or promote",),
    ),
    Template("bsd-disclaimer", _DISCLAIMER, ("procurement of substitute goods or services", "even if advised of the possibility")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely"),
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(fold_ascii(text), NOT_WORD), "")


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p in BASE for w in p.split()})


def _hits(words: Column, known: list[str]) -> Column:
    at = F.transform(words, lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("p"))))
    return F.filter(at, F.isnotnull)


def document_frequency(hits: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and for each template word the rows that hold it (as many numbers as templates have words)."""
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.transform("_hits", lambda h: h["w"])))
    counted = hits.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rows = {r["w"]: r["n"] for r in counted.collect()}
    return rows.pop("", 0), rows


def _voters(template: Template, idf: dict[str, float], votes: int) -> list[int]:
    """Places of the rarest words of a template's key phrases, as many as it takes votes.

    The key phrases stand in every match, so these words do too, whatever their share of the rows.
    """
    places = {q + k for q, key in template.key_places() for k in range(len(key))}
    return sorted(places, key=lambda q: (-idf[template.words[q]], q))[:votes]


def _postings(templates, idf: dict[str, float], votes: int) -> Column:
    """Every voting word's places, as one literal array: word, template number, place."""
    return F.array(*[F.struct(F.lit(template.words[q]).alias("w"), F.lit(t).alias("t"), F.lit(q).alias("q")) for t, template in enumerate(templates) for q in _voters(template, idf, votes)])


def _phrase_starts(hits: Column, phrase: str) -> Column:
    """Starts of a phrase whose words are all among the hits."""
    words = phrase.split()

    def stands(h: Column, i: Column) -> Column:
        out = h["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            out = out & F.coalesce((F.get(hits, i + k)["w"] == word) & (F.get(hits, i + k)["p"] == h["p"] + k), F.lit(False))
        return out

    return F.transform(F.filter(hits, stands), lambda h: h["p"])


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda x: F.struct(x.alias("at"), F.lit(label).alias("label")))


def _matches(hits: Column, templates, idf: dict[str, float], votes_needed: int, least: float) -> Column:
    """Structs of label and score for every verified template place."""
    votes_needed = min(votes_needed, *(len({q + k for q, key in t.key_places() for k in range(len(key))}) for t in templates))
    postings = _postings(templates, idf, votes_needed)
    voting = sorted({t.words[q] for t in templates for q in _voters(t, idf, votes_needed)})
    indexed = F.filter(F.transform(hits, lambda h, i: F.when(h["w"].isin(voting), F.struct(h["w"].alias("w"), h["p"].alias("p"), i.alias("i")))), F.isnotnull)

    def votes(found: Column) -> Column:
        def of(h: Column) -> Column:
            vote = lambda p: F.struct(p["t"].alias("t"), (h["p"] - p["q"]).alias("at"), h["i"].alias("i"))
            return F.transform(F.filter(postings, lambda p: p["w"] == h["w"]), vote)

        return F.sort_array(F.flatten(F.transform(found, of)))

    def agreed(v: Column) -> Column:
        same = lambda x, y: F.coalesce((x["t"] == y["t"]) & (x["at"] == y["at"]), F.lit(False))
        return F.filter(v, lambda x, i: same(x, F.get(v, i + votes_needed - 1)) & ~same(x, F.get(v, i - 1)))

    def verified(c: Column) -> Column:
        out = F.lit(None).cast("struct<label:string,score:double>")
        for t, template in enumerate(templates):
            n = len(template.words)
            keys = [f"{q + k} {w}" for q, key in template.key_places() for k, w in enumerate(key)]
            near = F.slice(hits, F.greatest(c["i"] - n, F.lit(0)) + 1, 2 * n + 1)
            seen = F.transform(near, lambda h: F.concat_ws(" ", h["p"] - c["at"], h["w"]))
            same = F.size(F.array_intersect(seen, F.lit([f"{q} {w}" for q, w in enumerate(template.words)])))
            whole = F.size(F.array_intersect(seen, F.lit(keys))) == len(keys)
            match = F.struct(F.lit(template.label).alias("label"), (same / n).alias("score"))
            out = F.when(c["t"] == t, F.when(whole & (same >= least * n), match)).otherwise(out)
        return out

    matched = lambda found: let(votes(found), lambda v: F.filter(F.transform(agreed(v), verified), F.isnotnull))
    nothing = F.array().cast("array<struct<label:string,score:double>>")
    return let(indexed, lambda found: F.when(F.size(found) < votes_needed, nothing).otherwise(matched(found)))


def scan_licenses(df: DataFrame, text: str = "text", templates=TEMPLATES, votes_needed: int = 2, least: float = 0.6, out: str = "licence") -> DataFrame:
    """df without its text, with a struct column `out`: n_words, base (starts and labels) and matches.

    One pass over the texts stores where template words stand. From that table come each word's
    document frequency and all matches: of each template, the rarest words of its key phrases vote
    for (template, relative place) wherever they stand in a text; places with `votes_needed` votes
    are kept if the template's key phrases stand where they must and `least` of its words agree.
    How frequent a licence is in the table, or how many a text holds, hides none.

    A null or empty text has no words and no labels. Each row depends on its text and on the corpus
    counts alone, so ties and repeated rows get equal results, and a very long text is read whole;
    other columns stay, and a column already named `out` is replaced. An empty table gives an empty
    result. As a match's key phrases stand where they must, its voting words do too: the votes find
    every place that trying each template at each place would.
    """
    known = template_words(templates)
    kept = [c for c in df.columns if c not in (text, out)]
    measured = let(words_of(df[text].cast("string")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _hits(w, known).alias("hits")))
    held = df.select(F.struct(*[df[c] for c in kept]).alias("_row") if kept else F.lit(None).cast("string").alias("_row"), measured.alias("_m"))
    held = stored(held.select("_row", F.col("_m.n").alias("_n"), F.col("_m.hits").alias("_hits")), "licence-hits")
    total, counts = document_frequency(held)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in known}
    base = lambda h: F.sort_array(F.concat(*[_labelled(_phrase_starts(h, p), BASE[p]) for p in BASE]))
    matches = _matches(F.col("_hits"), templates, idf, votes_needed, least)
    return held.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.struct(F.col("_n").alias("n_words"), base(F.col("_hits")).alias("base"), matches.alias("matches")).alias(out))


def license_rows(df: DataFrame) -> DataFrame:
    """The digest columns of op3 for a table of documents."""
    s = scan_licenses(df.select("doc_id", "text"), "text", out="_l")
    base, matches = F.col("_l.base"), F.col("_l.matches")
    at = F.transform(base, lambda b: b["at"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform(matches, lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["score"])), F.lit(0.0))
    return s.select(
        "doc_id",
        F.col("_l.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"),
    )
