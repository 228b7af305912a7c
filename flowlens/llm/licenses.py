"""Operator 5 [native]: licences in documents, recognised by ordered sequences of known sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, lower case, runs of other characters than
# letters and digits as one space. "*" at an end of a sentence stands for any words.
SENTENCES = {
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_title": "apache license",
    "apache_version": "version 2 0 january 2004",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_title": "the mit license",
    "mit_title_short": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy *",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind *",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl_title": "gnu general public license",
    "gpl3_version": "version 3 29 june 2007",
    "gpl2_version": "version 2 june 1991",
    "gpl_free": "this program is free software you can redistribute it and or modify it *",
    "gpl_hope": "this program is distributed in the hope that it will be useful *",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted *",
    "bsd_source": "redistributions of source code must retain the above copyright notice *",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice *",
    "bsd_name": "neither the name of *",
    "cc_by_nc_notice": "licensed under cc by nc 4 0",
    "cc_by_notice": "licensed under cc by 4 0",
    "cc_by_sa_notice": "licensed under cc by sa 4 0",
    "cc0_notice": "cc0 1 0 universal",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights": "all rights reserved",
    "lgpl_title": "gnu lesser general public license",
    "lgpl21_version": "version 2 1 february 1999",
    "lgpl_free": "this library is free software you can redistribute it and or modify it *",
    "lgpl_hope": "this library is distributed in the hope that it will be useful *",
    "lgpl_terms": "terms of the gnu lesser general public license",
    "agpl_title": "gnu affero general public license",
    "agpl_version": "version 3 19 november 2007",
    "agpl_terms": "terms of the gnu affero general public license",
    "isc_title": "isc license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely *",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost_title": "boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy *",
    "boost_notice": "distributed under the boost software license version 1 0",
    "eclipse_title": "eclipse public license v 2 0",
    "eclipse_notice": "terms of the eclipse public license v 2 0",
    "eclipse_notice_short": "terms of the eclipse public license 2 0",
    "mpl_title": "mozilla public license version 2 0",
    "artistic_title": "the artistic license 2 0",
    "wtfpl_title": "do what the fuck you want to public license",
}
# Rules, first those that take more sentences. A rule holds where its sentences occur in this order.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_condition", "as_is"]),
    ("Apache-2.0", ["apache_title", "apache_version"]),
    ("Apache-2.0", ["apache_notice", "apache_use"]),
    ("Apache-2.0", ["apache_notice"]),
    ("GPL-3.0", ["gpl_title", "gpl3_version"]),
    ("GPL-2.0", ["gpl_title", "gpl2_version"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL", ["gpl_free", "gpl_hope"]),
    ("MIT", ["mit_title", "mit_grant"]),
    ("MIT", ["mit_title_short", "mit_grant"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_licensed"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("LGPL-2.1", ["lgpl_title", "lgpl21_version"]),
    ("LGPL-3.0", ["lgpl_title", "gpl3_version"]),
    ("LGPL", ["lgpl_free", "lgpl_hope"]),
    ("LGPL", ["lgpl_terms"]),
    ("AGPL-3.0", ["agpl_title", "agpl_version"]),
    ("AGPL-3.0", ["agpl_terms"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["zero_grant"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost_title", "boost_grant"]),
    ("BSL-1.0", ["boost_notice"]),
    ("EPL-2.0", ["eclipse_notice"]),
    ("EPL-2.0", ["eclipse_notice_short"]),
    ("EPL-2.0", ["eclipse_title"]),
    ("MPL-2.0", ["mpl_title"]),
    ("Artistic-2.0", ["artistic_title"]),
    ("WTFPL", ["wtfpl_title"]),
]
#: Sentences that speak of a licence only where nothing else stands between two breaks; the others may stand among more words.
ALONE = {"apache_title", "apache_version", "mit_title", "mit_title_short", "gpl_title", "gpl2_version", "gpl3_version", "cc0_notice", "rights", "lgpl_title", "lgpl21_version", "agpl_title", "agpl_version", "isc_title", "eclipse_title", "mpl_title", "artistic_title", "wtfpl_title"}
#: Marks of a break that a known sentence may go across, as a line feed inside a paragraph, and of one where sentences end.
SOFT, HARD = "\x01", "\x02"
#: What becomes which mark: a version's "v." is no break, blank lines (bare comment marks too) and full stops are hard, line feeds, colons and semicolons soft.
BREAKS = [(r"(?i)\bv\.\s+(?=\d)", "v "), (r"[:;]*[.?!][.?!:;]*\s+|\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*", HARD), (r"[:;]+\s+|\n", SOFT)]
#: Every known sentence holds one of these words, its longest. Texts and sentences without any have no identifier.
HINTS = tuple(sorted({max(sentence.removesuffix(" *").split(), key=len) for sentence in SENTENCES.values()}))


def _pattern() -> str:
    """Finds the known sentences in a normal text, of those that begin at one place the longest."""
    words = {name: rf"[ {SOFT}]+".join(sentence.removesuffix(" *").split()) for name, sentence in SENTENCES.items()}
    longest = sorted(SENTENCES, key=lambda name: -len(SENTENCES[name]))
    ends = rf"(?= ?(?:[{SOFT}{HARD}]|\z))"
    alone = "|".join(words[n] for n in longest if n in ALONE)
    among = "|".join(words[n] for n in longest if n not in ALONE)
    edge = f" {SOFT}{HARD}"
    # "is not licensed under ..." is no notice
    return rf"(?<![^{edge}])(?:(?<!\bnot |n t |\bnever )(?:{among})(?![^{edge}])|(?<=\A|[{SOFT}{HARD}]|[{SOFT}{HARD}] )(?:{alone}){ends})"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    hint = "(?i)" + "|".join(HINTS)
    normal = F.translate(text, SOFT + HARD, "  ")
    for pattern, mark in BREAKS:
        normal = F.regexp_replace(normal, pattern, mark)
    normal = F.trim(F.lower(F.regexp_replace(normal, rf"[^\p{{L}}\p{{N}}{SOFT}{HARD}]+", " ")))
    found = F.regexp_extract_all(normal, F.lit(_pattern()), F.lit(0))
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s.removesuffix(" *"), name)])
    ids = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, rf"[ {SOFT}]+", " ")))
    return F.when(text.rlike(hint), ids).otherwise(F.expr("cast(array() as array<string>)"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (sorted, without repeats), n_sentences long and primary_license of every row.

    ``primary_license`` is that of the first rule that holds; null if none does.
    Null and empty texts have no sentences. Repeated rows come back as often.
    Sentences are matched as whole words after normalising, across the lines of
    a paragraph; titles must stand alone on a line or in a sentence, so a licence
    that is only named isn't one. One pass, no shuffle; other columns are not read.
    """
    ids = docs.select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("sentence_ids"))
    path = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    rules = [F.when(F.col("_path").like("%," + ",%,".join(r).replace("_", r"\_") + ",%"), F.lit(name)) for name, r in RULES]
    held = F.filter(F.array(*rules), lambda x: x.isNotNull())
    rows = ids.withColumn("_path", F.regexp_replace(path, ",", ",,"))
    return rows.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.sort_array(F.array_distinct(held)), ",").alias("licenses"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.coalesce(*rules).alias("primary_license"),
    )


def _oracle() -> str:
    values = ", ".join(f"({k}, '{name}', '{s.removesuffix(' *')}', {str(s.endswith('*')).lower()})" for k, (name, s) in enumerate(SENTENCES.items()))
    rules = ", ".join(f"({k}, '{name}', '%,{',%,'.join(r)},%')" for k, (name, r) in enumerate(RULES))
    hint = "|".join(HINTS)
    return rf"""
with known(k, name, sentence, open_end) as (values {values}),
rules(k, license, path) as (values {rules}),
s as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.?!:;]+[ \t\r\f\x0B]+|[.?!:;]*\n')) as s, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.?!:;]+[ \t\r\f\x0B]+|[.?!:;]*\n'), 1) as pos from documents),
t as (select doc_id, pos, trim(lower(regexp_replace(s, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) as s from s where regexp_matches(s, '(?i){hint}')),
i as (select doc_id, pos, (select arg_min(name, (open_end::int, k)) from known where t.s = sentence and not open_end or open_end and starts_with(t.s, sentence)) as id from t),
p as (select d.doc_id, count(i.id) as n, coalesce(string_agg(i.id, ',' order by i.pos), '') as ids from documents d left join (select * from i where id is not null) i on i.doc_id = d.doc_id group by d.doc_id),
h as (select p.doc_id, coalesce(string_agg(distinct license, ',' order by license), '') as licenses, arg_min(license, rules.k) as primary_license from p join rules on ',' || replace(p.ids, ',', ',,') || ',' like rules.path group by p.doc_id)
select p.doc_id, p.ids as sentence_ids, coalesce(h.licenses, '') as licenses, p.n::bigint as n_sentences, h.primary_license from p left join h on h.doc_id = p.doc_id
"""


ORACLE_SQL = _oracle()
