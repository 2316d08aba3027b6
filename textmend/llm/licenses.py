"""Licence scan by sentence rules.

Texts are cut into sentences and normalised (lower case, letters and digits only, marks at the beginning of lines
dropped). Known licence sentences are found from cut to cut, the longest first, and may be wrapped over lines; the
sequence of their identifiers is matched against ordered rules, the longest and most specific first, and what a rule has
matched no later rule sees.

Built-in functions only: no Python runs on the executors, nothing is shuffled; sentences and rules are literals of the
plan.

Edge cases: null and empty texts have no sentences, an empty identifier sequence and no licences; a sentence that speaks
of a licence but is not known gets the identifier UNKNOWN; repeated rows yield repeated result rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.llm.common import id_and_text

#: Known sentences as licences word them, by identifier.
SENTENCES = {
    "MIT_REF": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MIT_GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT_NOTICE": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "AS_IS": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "APACHE2_REF": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License 2.0."],
    "APACHE2_COMPLY": ["you may not use this file except in compliance with the License."],
    "APACHE2_COPY": ["You may obtain a copy of the License at"],
    "APACHE2_ASIS": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "GPL3_REF": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU General Public License, version 3."],
    "GPL2_REF": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License, version 2."],
    "GPL3_LATER": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL2_LATER": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL21_LATER": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL3_LATER": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL3_LATER": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL3_LATER_REF": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL2_LATER_REF": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL21_REF": ["SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL21_LATER_REF": ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL3_REF": ["SPDX-License-Identifier: LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."],
    "LGPL3_LATER_REF": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL3_REF": ["SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."],
    "AGPL3_LATER_REF": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL2_REF": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "MPL2_COPY": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "ISC_ASIS": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "ISC_REF": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License."],
    "EPL2_REF": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"],
    "EPL1_REF": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "SPDX-License-Identifier: EPL-1.0"],
    "UNLICENSE_GRANT": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "ZLIB_GRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib"],
    "BOOST_REF": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "BSD2_REF": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "GPL_HOPE": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "BSD_GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD_SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD_BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD_NAME": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD3_REF": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "CC_BY_NC_4_REF": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC_BY_4_REF": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC_BY_SA_4_REF": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0_REF": ["SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0."],
    "ALL_RIGHTS": ["All rights reserved."],
}
#: Licence and the sequence of identifiers that states it; earlier rules go first.
RULES = [
    ("MIT", "MIT_GRANT (MIT_NOTICE )?(AS_IS )?"), ("Apache-2.0", "APACHE2_REF APACHE2_COMPLY (APACHE2_COPY )?(APACHE2_ASIS )?"), ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_NAME "),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY "), ("GPL-3.0-or-later", "GPL3_LATER (GPL_HOPE )?"), ("GPL-2.0-or-later", "GPL2_LATER (GPL_HOPE )?"), ("MIT", "MIT_REF "), ("Apache-2.0", "APACHE2_REF "),
    ("GPL-3.0-only", "GPL3_REF "), ("GPL-2.0-only", "GPL2_REF "), ("BSD-3-Clause", "BSD3_REF "), ("BSD-2-Clause", "BSD2_REF "), ("LGPL-2.1-or-later", "(LGPL21_LATER|LGPL21_LATER_REF) "), ("LGPL-3.0-or-later", "(LGPL3_LATER|LGPL3_LATER_REF) "),
    ("AGPL-3.0-or-later", "(AGPL3_LATER (GPL_HOPE )?|AGPL3_LATER_REF )"), ("GPL-3.0-or-later", "GPL3_LATER_REF "), ("GPL-2.0-or-later", "GPL2_LATER_REF "), ("LGPL-2.1-only", "LGPL21_REF "), ("LGPL-3.0-only", "LGPL3_REF "), ("AGPL-3.0-only", "AGPL3_REF "),
    ("MPL-2.0", "MPL2_REF (MPL2_COPY )?"), ("ISC", "(ISC_GRANT (ISC_ASIS )?|ISC_REF )"), ("EPL-2.0", "EPL2_REF "), ("EPL-1.0", "EPL1_REF "), ("Unlicense", "UNLICENSE_GRANT "), ("Zlib", "ZLIB_GRANT "), ("BSL-1.0", "BOOST_REF "), ("CC-BY-NC-4.0", "CC_BY_NC_4_REF "), ("CC-BY-SA-4.0", "CC_BY_SA_4_REF "), ("CC-BY-4.0", "CC_BY_4_REF "),
    ("CC0-1.0", "CC0_REF "), ("Proprietary", "COPYRIGHT (ALL_RIGHTS )"),
]
HINT = r"(?i)licen[sc]|copyright|permission is hereby|permission is granted|hereby granted|\bmpl\b|\bspdx|redistribution|warrant|creative commons|\bcc (by|0)|rights reserved|public domain|free software"
CUT, ABOUT = r"[.!?;:]+\s+", r"licen[sc]|copyright|warrant"
#: What stands for the end of a sentence and for the end of a line.
END, LINE = "\x01", "\x02"


def pieces(text: Column) -> Column:
    """The normalised text, its sentences and lines apart. Comment marks and blanks at the beginning of a line go first, so
    that none of them cuts a wrapped sentence."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), r"\n[^\p{L}\p{N}]*", "\n"), CUT, END)
    return F.concat(F.lit(LINE), F.regexp_replace(F.translate(cut, "\n", LINE), f"[^a-z0-9{END}{LINE}]+", " "), F.lit(LINE))


def known() -> list[tuple[str, str]]:
    """(pattern over pieces, identifier), the longest sentence first: words may stand on different lines, and are cut only
    where the sentence itself is."""
    out = []
    for name, texts in SENTENCES.items():
        for text in texts:
            sentence = re.sub(f"[^a-z0-9{END}]+", " ", re.sub(CUT, END, text.lower())).strip()
            words = re.split(f" *{END} *| ", sentence)
            gaps = [f"[ {LINE}{END}]+" if END in g else f"[ {LINE}]+" for g in re.findall(f" *{END} *| ", sentence)]
            body = "".join(x for pair in zip(words, [*gaps, ""], strict=True) for x in pair)
            out.append((len(words), f"([{END}{LINE}]) ?{body}(?= ?[{END}{LINE}])", name))
    return [(pattern, name) for _, pattern, name in sorted(out, key=lambda x: -x[0])]


def identifiers(text: Column) -> Column:
    """Identifiers of the text's sentences in order; those that have nothing to do with licences have none."""
    marked = pieces(text)
    for pattern, name in known():
        marked = F.regexp_replace(marked, pattern, f"$1#{name}")

    def one(piece: Column) -> Column:
        return F.when(piece.startswith("#"), F.substring(piece, 2, 100)).when(piece.rlike(r"^(c )?copyright (c )?[a-z0-9]"), "COPYRIGHT").when(piece.rlike(ABOUT), "UNKNOWN")

    return F.filter(F.transform(F.split(marked, f"[{END}{LINE}]"), lambda x: one(F.trim(x))), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_unknown): identifiers in text order, licences sorted; one row per input row."""
    rows = id_and_text(docs, id_col, text_col)
    ids = identifiers(F.col("text"))
    rows = rows.select(F.col("id").alias("doc_id"), F.when(F.col("text").rlike(HINT), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    left = F.transform("ids", lambda x: F.concat(x, F.lit(" ")))
    rows = rows.withColumn("rest", F.array_join(left, "")).withColumn("licenses", F.array().cast("array<string>"))
    for k, (name, rule) in enumerate(RULES):
        rule = rf"(?<![^ ]){rule}"
        rows = rows.withColumns({"licenses": F.when(F.col("rest").rlike(rule), F.array_union("licenses", F.array(F.lit(name)))).otherwise(F.col("licenses")), "rest": F.regexp_replace("rest", rule, f"#{k} ")})
    return rows.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.array_join(F.sort_array("licenses"), ",").alias("licenses"), F.size(F.filter("ids", lambda x: x == "UNKNOWN")).cast("long").alias("n_unknown"))
