import duckdb
import pandas as pd
import pytest

from quizlake.llm.licenses import NAMES, oracle, scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
UNLICENSE = """This is free and unencumbered software released into the public
domain."""
GNU = """This {} is free software: you can redistribute it and/or modify
it under the terms of the GNU {} General Public License as
published by the Free Software Foundation, either version {} of the
License, or (at your option) any later version.

This {} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
CC0 = """To the extent possible under law, the author has waived all copyright
and related or neighboring rights to this work."""
TITLES = {
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "Apache-2.0": "Apache License\n  Version 2.0, January 2004",
}
TEXTS = {
    "LGPL-2.1-or-later": GNU.format("library", "Lesser", "2.1", "library"), "LGPL-3.0-or-later": GNU.format("library", "Lesser", "3", "library"),
    "AGPL-3.0-or-later": GNU.format("program", "Affero", "3", "program"), "ISC": ISC, "Zlib": ZLIB, "BSL-1.0": BOOST, "EPL-2.0": EPL, "CC0-1.0": CC0,
    "MIT": MIT, "GPL-2.0-or-later": GPL.format(2), "GPL-3.0-or-later": GPL.format(3), "MPL-2.0": MPL, "Apache-2.0": APACHE,
    "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Unlicense": UNLICENSE,
}
SHORT = {
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "-- "])
def test_standard_texts_plain_and_in_comments(spark, mark):
    wanted = [*TEXTS.items(), *SHORT.items(), *TITLES.items(), *[(name, f"SPDX-License-Identifier: {name}") for name in NAMES]]
    rows = [(n, "Some words before.\n\n" + "\n".join(mark + line for line in text.split("\n")) + "\n\nAnd after") for n, (_, text) in enumerate(wanted)]
    found = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {n: [name] for n, (name, _) in enumerate(wanted)}


def test_sql_agrees_on_wrapped_texts(spark):
    texts = [f"Words.\n\n{mark}" + text.replace("\n", f"\n{mark}") + "\nmore" for mark in ("", " * ", "# ") for text in [*TEXTS.values(), *SHORT.values(), *TITLES.values()]]
    texts += [None, "", ISC + "\n" + ZLIB + "\n" + MIT, "the licence of a driver", MIT + MIT]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841 - read by DuckDB
    found = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted((r["doc_id"], ",".join(r["sentence_ids"]), ",".join(r["licenses"])) for r in found.collect())
    assert got == sorted(duckdb.sql(oracle()).fetchall())
