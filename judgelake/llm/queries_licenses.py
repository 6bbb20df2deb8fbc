"""Registered query: licences of all documents, laid out as a tree of files."""

from pyspark.sql import functions as F

from judgelake.llm import licenses
from judgelake.llm.common import table
from judgelake.llm.registry import query

#: The notices by which works commonly state these licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def laid_out(docs):
    """doc_id, path, text: the source is the top folder, 1,024 and then 32 documents share
    one below it, and the first of each 32 is the folder's licence file."""
    k = F.coalesce(F.col("doc_id"), F.lit(-1))
    name = F.when(k % 32 == 0, "LICENSE").otherwise(F.concat(F.lit("f"), k.cast("string"), F.lit(".txt")))
    tops = [F.coalesce("source", F.lit("none")), F.floor(k / 1024).cast("string"), F.floor(k / 32).cast("string")]
    return docs.select("doc_id", F.concat_ws("/", *tops, name).alias("path"), "text")


@query("op9_licenses")
def op9_licenses(spark, sf_dir):
    return licenses.scan(laid_out(table(spark, sf_dir, "documents")), TEMPLATES, keep=("doc_id",))
