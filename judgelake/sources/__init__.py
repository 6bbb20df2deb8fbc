"""Readers and writers: ledgers, TSV goldens, change documents, review threads."""
