from __future__ import annotations

import random
import re

from flowlens.llm import licenses

APACHE = """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
"""
APACHE_COMMENT = """# Licensed under the Apache License,
# Version 2.0 (the "License"); you may not use this file except in
# compliance with the License.
#
# Unless required by applicable law"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GPL3_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
WANT = [
    (APACHE, "apache_notice,apache_use", "Apache-2.0"),
    (APACHE_COMMENT, "apache_notice,apache_use", "Apache-2.0"),
    (APACHE_TEXT, "apache_title,apache_version", "Apache-2.0"),
    (MIT, "mit_grant,mit_condition,as_is", "MIT"),
    (BSD2, "bsd_grant,bsd_source,bsd_binary", "BSD-2-Clause"),
    (BSD3, "bsd_grant,bsd_source,bsd_binary,bsd_name", "BSD-3-Clause"),
    (GPL, "gpl_free,gpl_hope", "GPL"),
    (GPL.replace("software:", "software;"), "gpl_free,gpl_hope", "GPL"),
    (GPL3_TEXT, "gpl_title,gpl3_version", "GPL-3.0"),
    (MPL, "mpl_notice", "MPL-2.0"),
    ("This project is licensed under the MIT License, see LICENSE.", "mit_licensed", "MIT"),
    ("This project is licensed\nunder the MIT\nLicense.", "mit_licensed", "MIT"),
    ("Prose.\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "cc_by_nc_notice,rights", "CC-BY-NC-4.0"),
    # Only talked about: a title among other words, a denial, a longer word, a notice cut by the end of a paragraph.
    ("We compared the MIT License with the Apache License and kept all rights reserved.", "", None),
    ("This isn't licensed under the MIT License, and that is not released under the MIT License.", "", None),
    ("Licensed under the Apache License, Version 2.01", "", None),
    ("It is licensed under\n\nthe MIT License", "mit_title", None),
    ("Permission.\x01It is licensed under the MIT\x02License", "mit_licensed", "MIT"),
    (None, "", None),
]


def test_standard_texts(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(WANT)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[i]["sentence_ids"], out[i]["primary_license"]) for i, _ in rows] == [(ids, name) for _, ids, name in WANT]
    assert all(out[i]["n_sentences"] == len(ids.split(",")) * bool(ids) for i, (_, ids, _) in enumerate(WANT))


MORE = [
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.", "LGPL"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n", "LGPL-2.1"),
    ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.", "AGPL-3.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "AGPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for\nany purpose with or without fee is hereby granted.", "0BSD"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software", "BSL-1.0"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at", "EPL-2.0"),
    ("Mozilla Public License Version 2.0\n==================================\n", "MPL-2.0"),
    (MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (APACHE_TEXT, "Apache-2.0"), (GPL, "GPL"), (GPL3_TEXT, "GPL-3.0"), (MPL, "MPL-2.0"),
]


def matched(text):
    """Known sentences of a text, by its words and the marks between them, one word after the other."""
    tokens = []
    text = re.sub(r"(?i)\bv\.\s+(?=\d)", "v ", text)
    for part in re.split(r"([:;]*[.?!][.?!:;]*\s+|\n[^\w\n]*\n[^\w]*|[:;]+\s+|\n)", text):
        if re.search(r"[^\W_]", part):
            tokens += re.findall(r"[^\W_]+", part.lower())
        elif part:
            tokens.append("\x02" if re.match(r"[:;]*[.?!]|\n[^\w\n]*\n", part) else "\x01")
    out, at = [], 0
    while at < len(tokens):
        best = None
        for name, sentence in licenses.SENTENCES.items():
            want, j = sentence.removesuffix(" *").split(), at
            for w in want:
                while j > at and j < len(tokens) and tokens[j] == "\x01":
                    j += 1
                if j >= len(tokens) or tokens[j] != w:
                    break
                j += 1
            else:
                before, after = tokens[at - 1] if at else "\x02", tokens[j] if j < len(tokens) else "\x02"
                alone = before in "\x01\x02" and after in "\x01\x02"
                denied = at and (before in ("not", "never") or before == "t" and at > 1 and tokens[at - 2].endswith("n"))
                if (alone if name in licenses.ALONE else not denied) and (best is None or len(sentence) > len(licenses.SENTENCES[best[0]])):
                    best = name, j
        if best:
            out.append(best[0])
            at = best[1]
        else:
            at += 1
    return out


def by_rules(ids):
    def held(rule):
        it = iter(ids)
        return all(x in it for x in rule)

    return [name for name, rule in licenses.RULES if held(rule)]


def test_canonical_texts_wrapped_and_in_one_line(spark):
    texts = [t for t, _ in MORE] + [re.sub(r"(?<=\S)\n(?=\S)", " ", t) for t, _ in MORE]
    rng = random.Random(2)
    texts += [rng.choice(["Some prose before it. ", "Words\n\n", "A line\n"]) + rng.choice(MORE)[0] + rng.choice([". And after.", "\n\nmore", " and so on"]) + rng.choice(["", "\n\n" + rng.choice(MORE)[0]]) for _ in range(150)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (_, name) in enumerate(MORE):
        assert out[i]["primary_license"] == name, (MORE[i][0], out[i])
    for i, t in enumerate(texts):
        ids = matched(t)
        assert out[i]["sentence_ids"] == ",".join(ids), t
        assert out[i]["primary_license"] == next(iter(by_rules(ids)), None) and out[i]["licenses"] == ",".join(sorted(set(by_rules(ids))))


def test_nulls_long_texts_repeats_and_names(spark):
    long = "word " * 2_000_000 + ".\n\n" + MIT
    rows = [(1, None, "a", 1), (2, "", "a", 1), (None, MIT, "a", 1), (3, MIT, "a", 1), (3, MIT, "a", 1), (4, long, "a", 1), (5, "no such words", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string, sentence_ids int")
    out = sorted((str(r["doc_id"]), r["primary_license"], r["n_sentences"]) for r in licenses.scan(df).collect())
    assert out == sorted([("1", None, 0), ("2", None, 0), ("None", "MIT", 3), ("3", "MIT", 3), ("3", "MIT", 3), ("4", "MIT", 3), ("5", None, 0)], key=str)
    assert licenses.scan(df.limit(0)).count() == 0
