"""Licence notices as files have them, wrapped at about 75 columns, with and without comment marks."""

import textwrap

import pytest

from meshwright.llm import license_scan

NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_wrapped_notices(spark, docs, mark, feed):
    model = license_scan.fit(docs)
    long_text = "stone river bridge light " * 30
    texts = []
    for k, notice in enumerate(NOTICES.values()):
        lines = textwrap.wrap(notice, 75 - len(mark))
        assert len(lines) > 1
        texts.append((2 * k, feed.join(mark + line for line in lines)))
        texts.append((2 * k + 1, feed.join([long_text, "", "house", mark, *(mark + line for line in lines), mark, "", long_text])))
    texts.append((6, feed.join(["river stone", "", "a bridge", "of light", "", "", "garden"])))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r["doc_id"]: r["families"] for r in license_scan.scan(df, model).collect()}
    assert found == {2 * k + more: [family] for k, family in enumerate(NOTICES) for more in (0, 1)} | {6: []}
