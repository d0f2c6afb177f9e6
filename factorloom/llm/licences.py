"""Licence scans: sentences in normal form become known identifiers, and their sequence is held against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import free_name

#: Sentences of well-known licences and of notices that name them.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-at": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-notice-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-redistribute-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-notice-2": "This work is licensed under the GNU General Public License, version 2",
    "gpl-short-2": "Licensed under the GNU General Public License, version 2",
    "gpl-short-3": "Licensed under the GNU General Public License, version 3",
    "gpl-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-version-2": "version 2 of the License",
    "lgpl-free": "This library is free software",
    "lgpl-redistribute-21": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-short-21": "Licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl-short-3": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-short-3": "Licensed under the GNU Affero General Public License, version 3",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-short-2": "Licensed under the BSD 2-Clause License",
    "bsd-short-3": "Licensed under the BSD 3-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-short": "Licensed under the ISC License",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "cc0-waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "mpl-short": "Licensed under the Mozilla Public License, Version 2.0",
}
#: A licence is found if the identifiers of one of its rules occur in this order; others may stand between them.
RULES = (
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-copy", "apache-unless")),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-copy-at", "apache-unless")),
    ("GPL-3.0", ("gpl-notice-3",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute-2")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute-3")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("GPL-2.0", ("gpl-notice-2",)),
    ("GPL-2.0", ("gpl-short-2",)),
    ("GPL-2.0", ("gpl-free", "gpl-only", "gpl-version-2")),
    ("GPL-3.0", ("gpl-short-3",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-redistribute-21")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-redistribute-3")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-redistribute-3")),
    ("LGPL-2.1", ("lgpl-short-21",)),
    ("LGPL-3.0", ("lgpl-short-3",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-redistribute-3")),
    ("AGPL-3.0", ("agpl-short-3",)),
    ("BSD-2-Clause", ("bsd-short-2",)),
    ("BSD-3-Clause", ("bsd-short-3",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("ISC", ("isc-short",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("EPL-2.0", ("epl-2",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("MPL-2.0", ("mpl-short",)),
    ("MPL-2.0", ("mpl-header", "mpl-copy")),
    ("MPL-2.0", ("mpl-header", "mpl-copy-s")),
)
#: The Creative Commons licences: the code, and the name in the long notices.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _name in _CC.items():
    for _no, _port in (("4.0", "International"), ("3.0", "Unported")):
        for _kind, _text in {"short": f"Licensed under CC {_code} {_no}", "work": f"This work is licensed under CC {_code} {_no}", "long": f"This work is licensed under a Creative Commons {_name} {_no} {_port} License"}.items():
            _id = f"cc-{_code.lower()}-{_no[0]}-{_kind}"
            if _text not in SENTENCES.values():
                SENTENCES[_id] = _text
                RULES = (*RULES, (f"CC-{_code}-{_no}", (_id,)))
#: Where a sentence ends for certain: at . ! ? ; : before white space or the end. It also ends at a blank line; at a single line feed it may end or go on.
END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)"
NOISE = "[^a-z0-9.]+"


def _plain(sentence: str) -> str:
    """Lower case; all but letters a to z, digits and points become single spaces."""
    import re

    return re.sub(NOISE, " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normal form to identifier."""
    return {_plain(text): name for name, text in sentences.items()}


def _pattern(known: list[str]) -> str:
    """Any of the sentences from a line's start to a line's end, over single line feeds; of several that start together the longest."""
    each = ["[ \\n]".join(x.replace(".", r"\.") for x in s.split()) for s in sorted(known, key=len, reverse=True)]
    return rf"(?<![^\n])(?:{'|'.join(each)})(?![^\n])"


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in its order; lines may wrap inside of them, with comment signs before each."""
    known = known_sentences(sentences)
    ended = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), END, "\n\n")
    lines = F.regexp_replace(F.regexp_replace(ended, r"[^a-z0-9.\n]+", " "), " ?\n ?", "\n")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(F.regexp_extract_all(F.trim(lines), F.lit(_pattern(list(known))), F.lit(0)), lambda s: F.element_at(table, F.translate(s, "\n", " ")))


def _holds(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the rule is a subsequence: one pass that counts how far the rule has come."""
    steps = F.array(*[F.lit(x) for x in rule])
    return F.aggregate(ids, F.lit(0), lambda n, x: n + F.when(F.get(steps, n) == x, F.lit(1)).otherwise(F.lit(0))) == len(rule)


def scan(df: DataFrame, text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """Adds the struct column licence_column(df): sentence_ids, and licences by first rule that found them.

    One projection, no shuffle. Null and empty texts have neither; rows are taken one by one, so repeated rows give
    repeated results; the column takes a free name.
    """
    ids, name = free_name(df, "licence_ids"), licence_column(df)
    out = df.withColumn(ids, identifiers(F.col(f"`{text_col}`"), sentences))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(_holds(F.col(ids), rule), F.lit(licence)) for licence, rule in rules])))
    none = F.array().cast("array<string>")
    return out.withColumn(name, F.struct(F.col(ids).alias("sentence_ids"), F.when(F.size(ids) > 0, found).otherwise(none).alias("licences"))).drop(ids)


def licence_column(df: DataFrame) -> str:
    return free_name(df, "licence")
