import re
import textwrap

from tests.conftest import SF
from textmend.llm import licenses

MIT = "\n".join(licenses.SENTENCES[k][0] for k in ("MIT_GRANT", "MIT_NOTICE", "AS_IS"))
APACHE = '\n'.join(['Licensed under the Apache License, Version 2.0 (the "License");', *(licenses.SENTENCES[k][0] for k in ("APACHE2_COMPLY", "APACHE2_COPY")), "http://x", licenses.SENTENCES["APACHE2_ASIS"][0]])


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as rest", "3 as licenses")
    return [(r.sentence_ids, r.licenses, r.n_unknown) for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_sentences_and_rules(spark):
    texts = ["Copyright (c) 2020 A. Person\n\n" + MIT, APACHE, "Text. released UNDER the MIT license!  More text", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "This file has its own license terms.", "Copyright 2001 X\nAll rights reserved.", "nothing", "", None,
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "\n".join(licenses.SENTENCES[k][0] for k in ("BSD_SOURCE", "BSD_BINARY"))]
    got = scanned(spark, texts)
    assert [g[1] for g in got] == ["MIT", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "", "Proprietary", "", "", "", "BSD-2-Clause"]
    assert got[0][0] == "COPYRIGHT MIT_GRANT MIT_NOTICE AS_IS"
    assert got[3][0] == "CC_BY_NC_4_REF CC_BY_NC_4_REF" and got[4] == ("UNKNOWN", "", 1)


def test_every_known_sentence_is_found(spark):
    names, texts = zip(*((k, t) for k, ts in licenses.SENTENCES.items() for t in ts), strict=True)
    assert all(n in g[0].split() for n, g in zip(names, scanned(spark, list(texts)), strict=True))


def test_documents_equal_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    want = {r.doc_id: ",".join(sorted({v for k, v in lines.items() if re.search(r"(^|[.!?] |\n)" + re.escape(k), r.text)})) for r in docs.collect()}
    assert {r.doc_id: r.licenses for r in licenses.scan(docs).collect()} == want


def test_empty_table(spark):
    assert scanned(spark, []) == []


def test_tags_name_their_licence(spark):
    tags = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "BSD-3-Clause", "CC0-1.0"]
    assert [g[1] for g in scanned(spark, [f"// SPDX-License-Identifier: {t}\nint main;" for t in tags])] == tags
    assert scanned(spark, ["/* SPDX-License-Identifier: LGPL-2.1 */", "# SPDX-License-Identifier: MIT OR Zlib"]) == [("UNKNOWN", "", 1)] * 2


def test_wrapped_texts(spark):
    wrap = lambda name, mark: "\n".join(mark + line for line in textwrap.wrap(licenses.SENTENCES[name][0], 72))
    bsd = ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]
    texts = ["\n\n".join(wrap(n, m) for n in names) for m in ("", "# ", " * ", ";; ", "// ") for names in (["MIT_GRANT", "MIT_NOTICE", "AS_IS"], bsd, bsd[:3], ["GPL3_LATER", "GPL_HOPE"], ["GPL2_LATER", "GPL_HOPE"], ["APACHE2_REF", "APACHE2_COMPLY", "APACHE2_ASIS"])]
    got = scanned(spark, texts)
    assert [g[1] for g in got] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-or-later", "GPL-2.0-or-later", "Apache-2.0"] * 5
    assert not any(g[2] for g in got)


def test_whole_licences_and_unlisted_tags(spark):
    isc = "ISC License\n\nCopyright (c) 2020 Jo Doe\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANYTHING.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint main() {}"
    lgpl = "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n"
    tags = ["AGPL-3.0-or-later", "LGPL-3.0-only", "EPL-2.0", "BSD-2-Clause", "Unlicense", "Zlib", "BSL-1.0", "ISC", "MPL-2.0", "GPL-2.0-or-later"]
    got = scanned(spark, [isc, mpl, lgpl, *[f"// SPDX-License-Identifier: {t}\n" for t in tags], "// SPDX-License-Identifier: Foo-9.9\ncode", "word " * 200_000 + "\nLicensed under the ISC License.\n"])
    assert [g[1] for g in got] == ["ISC", "MPL-2.0", "LGPL-2.1-or-later", *tags, "", "ISC"]
    assert got[-2][2] == 1 and got[1][2] == 0
