"""Small tables for the tests of the repository operators."""

SF = "/root/testdata/sf0.001"


def listing(spark, paths_sizes, repo="r1", with_content=None):
    """Build a files (or files + content) frame from (path, size) pairs in
    listing order."""
    rows = []
    for i, ps in enumerate(paths_sizes):
        path, size = ps[0], ps[1]
        row = {"repo": repo, "file_seq": i, "path": path, "name": path.rsplit("/", 1)[-1],
               "type": "file", "size": size}
        if with_content is not None:
            row["content"] = with_content.get(path)
        rows.append(row)
    schema = "repo string, file_seq bigint, path string, name string, type string, size bigint"
    if with_content is not None:
        schema += ", content string"
    return spark.createDataFrame(rows, schema)


def contents(spark, files: dict, repo="r1"):
    rows = [{"repo": repo, "path": p, "file_seq": i, "content": c} for i, (p, c) in enumerate(files.items())]
    return spark.createDataFrame(rows, "repo string, path string, file_seq bigint, content string")
