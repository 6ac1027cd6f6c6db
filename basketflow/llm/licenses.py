"""License scans by sentence rules.

A text is cut into lines and after . ! ? ; : before white space, each piece lower-cased with
runs of all but a-z and 0-9 made one space. A known sentence is found where whole pieces make it: with
single line ends (and comment marks) for any of its spaces, and cuts where it has punctuation itself; other
punctuation and blank lines end it, the longest known one wins. Known sentences have ids; a
text's sequence of ids is matched against ordered rules, each a run of ids that are next to
each other in that sequence (other sentences may lie between). Only texts that hold one of
KEYWORDS are cut: every known sentence holds one.

Defined results: a null or empty text has no ids and no licences; a repeated sentence counts
each time; a licence that several rules give is named once; names are in order; repeated rows come back
each; a column that has the name of an added one is replaced by it, and the other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences by id.
SENTENCES = {
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "apache-2-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-may": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-name": "The MIT License (MIT)",
    "mit-name-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-name": "Apache License Version 2.0, January 2004",
    "apache-foundation": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache-asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");',
    "apache-short": "Licensed under the Apache License 2.0.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-code": "This code is licensed under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "isc-name": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl-2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-name": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-name": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-21-name": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3-name": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-name": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "bsd-2-name": "BSD 2-Clause License",
    "bsd-3-name": "BSD 3-Clause License",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors, under its license.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2-name": "Mozilla Public License Version 2.0",
    "mpl-11": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "epl-1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-1": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1-name": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    "wtfpl-2": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-name": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "artistic-2-name": "The Artistic License 2.0",
    "eupl-12": "Licensed under the EUPL, Version 1.2 only",
    "ofl-11": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "postgresql": "PostgreSQL is released under the PostgreSQL License, a liberal Open Source license, similar to the BSD or MIT licenses.",
    "ncsa-name": "University of Illinois/NCSA Open Source License",
    "psf-2-name": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "osl-3": "Licensed under the Open Software License version 3.0",
    "afl-3": "Licensed under the Academic Free License version 3.0",
    "ms-pl-name": "Microsoft Public License (Ms-PL)",
}
#: The terms of Creative Commons licences and their versions.
TERMS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Licence and ordered ids.
RULES = (
    ("Apache-2.0", ("apache-2",)), ("Apache-2.0", ("apache-2-the", "apache-may", "apache-copy")), ("Apache-2.0", ("apache-2-the", "apache-may")),
    ("MIT", ("mit-released",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-name",)), ("MIT", ("mit-name-short", "mit-grant")),
    ("GPL-3.0", ("gpl-3-work",)), ("GPL-2.0", ("gpl-2-work",)), ("GPL-3.0", ("gpl-redistribute", "gpl-warranty")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)), ("CC-BY-4.0", ("cc-by-4",)), ("CC-BY-SA-4.0", ("cc-by-sa-4",)), ("CC-BY-4.0", ("cc-by-4-long",)), ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("MPL-2.0", ("mpl-2",)),
    ("Apache-2.0", ("apache-name",)), ("Apache-2.0", ("apache-foundation", "apache-asf")), ("Apache-2.0", ("apache-short",)), ("MIT", ("mit-this",)), ("MIT", ("mit-code",)), ("MIT", ("mit-distributed",)),
    ("X11", ("mit-grant", "mit-notice", "x11-name")), ("X11", ("mit-grant", "mit-notice", "mit-as-is", "x11-name")), ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-and",)), ("0BSD", ("0bsd-grant",)),
    ("GPL-2.0", ("gpl-2-redistribute", "gpl-warranty")), ("GPL-2.0", ("gpl-2-only",)), ("GPL-2.0", ("gpl-2-name",)), ("GPL-3.0", ("gpl-3-name",)), ("LGPL-2.1", ("lgpl-21-redistribute",)), ("LGPL-2.1", ("lgpl-21-name",)),
    ("LGPL-3.0", ("lgpl-3-redistribute",)), ("LGPL-3.0", ("lgpl-3-name",)), ("AGPL-3.0", ("agpl-3-redistribute",)), ("AGPL-3.0", ("agpl-3-name",)), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("MPL-2.0", ("mpl-2-name",)), ("MPL-1.1", ("mpl-11",)), ("EPL-1.0", ("epl-1",)), ("EPL-2.0", ("epl-2",)), ("CDDL-1.0", ("cddl-1",)), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0-1",)), ("CC0-1.0", ("cc0-1-name",)),
    ("WTFPL", ("wtfpl-2",)), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-name",)), ("BSL-1.0", ("boost-distributed",)), ("Artistic-2.0", ("artistic-2-name",)), ("EUPL-1.2", ("eupl-12",)), ("OFL-1.1", ("ofl-11",)),
    ("PostgreSQL", ("postgresql",)), ("NCSA", ("ncsa-name",)), ("PSF-2.0", ("psf-2-name",)), ("OSL-3.0", ("osl-3",)), ("AFL-3.0", ("afl-3",)), ("MS-PL", ("ms-pl-name",)),
)
for _terms, _name in TERMS.items():
    for _version, _kind in VERSIONS.items():
        _id = f"cc-{_terms.lower()}-{_version}"
        SENTENCES |= {k: v for k, v in {f"{_id}-short": f"Licensed under CC {_terms} {_version}.", f"{_id}-long": f"This work is licensed under a Creative Commons {_name} {_version} {_kind} License.", f"{_id}-the": f"This work is licensed under the Creative Commons {_name} {_version} {_kind} License."}.items() if v not in SENTENCES.values()}
        RULES += tuple((f"CC-{_terms}-{_version}", (k,)) for k in (f"{_id}-short", f"{_id}-long", f"{_id}-the") if k in SENTENCES)
KEYWORDS = "licen[cs]|permission|redistribut|warrant|copyright|comply|compliance|applicable law|public domain|authori[sz]ation"
_END = r"([.!?;:])\s+"
_HARD = "\x02"


def normal(sentence: str) -> str:
    """A sentence's pieces, with _HARD between them."""
    return _HARD.join(p for x in re.sub(_END, "\\1" + _HARD, sentence.lower()).split(_HARD) if (p := re.sub("[^a-z0-9]+", " ", x).strip()))


KNOWN = {normal(text): k for k, text in SENTENCES.items()}
#: Known sentences, longest first, in which a line may end at any space.
ANY_KNOWN = "|".join(k.replace(" ", "[ \n]") for k in sorted(KNOWN, key=len, reverse=True))
_PATTERN = f"(?<![^\n{_HARD}])(?:{ANY_KNOWN})(?![^\n{_HARD}])"


def sequence(text: Column) -> Column:
    """Ids of a text's known sentences, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    table = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))
    plain = F.regexp_replace(F.replace(low, F.lit(_HARD), F.lit(" ")), r"(?m)^[^a-z0-9\n]*(?:dnl|rem)(?= |$)", "")
    for pattern, by in ((_END, _HARD), (r"\n[^a-z0-9\n]*(?=\n)", _HARD), (f"[^a-z0-9\n{_HARD}]+", " "), (f" ?([\n{_HARD}]) ?", "$1"), ("^ | $", "")):
        plain = F.regexp_replace(plain, pattern, by)
    ids = F.transform(F.regexp_extract_all(plain, F.lit(_PATTERN), F.lit(0)), lambda s: F.try_element_at(table, F.replace(s, F.lit("\n"), F.lit(" "))))
    return F.when(low.rlike(KEYWORDS), ids).otherwise(F.array().cast("array<string>"))


def licensed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds sentence_ids and licenses (arrays) to docs."""
    ids = sequence(F.col(f"`{text}`"))
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("sentence_ids", "licenses")), ids.alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    names = F.array(*(F.when(line.contains(f" {' '.join(ids)} "), F.lit(name)) for name, ids in RULES))
    return docs.withColumn("licenses", F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))))


def digest(docs: DataFrame) -> DataFrame:
    got = licensed(docs.select("doc_id", "text"))
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
