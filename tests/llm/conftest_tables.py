"""Documents of a DataFrame as a table folder."""


def folder_of(folder, docs):
    docs.coalesce(1).write.parquet(str(folder / "parts"))
    (part,) = (folder / "parts").glob("part-*.parquet")
    part.rename(folder / "documents.parquet")
    for t in ("labels", "benchmark", "pages"):
        (folder / f"{t}.parquet").write_bytes((folder / "documents.parquet").read_bytes())
    return str(folder)
