"""Small datasets on disk."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

SAMPLES = ("alder", "birch", "cedar", "rowan")
#: File names run against locus order.
FILES = {"w": [(1, 10, "T,C"), (1, 12, "A,T")], "t": [(1, 12, "G,T"), (1, 17, "C")], "m": [(3, 4, "A"), (3, 9, "A,C,G")], "b": [(3, 9, "T,A"), (4, 2, "G,C")]}


def arrow(rows, packed=False, sample=None, nullable=False):
    """rows: (ordinal, position, alleles) or those and a sample."""
    fields, columns = [], []
    if packed:
        fields.append(pa.field("locus", pa.int64(), False))
        columns.append(pa.array([r[0] << 32 | r[1] for r in rows], pa.int64()))
    else:
        fields += [pa.field("contig", pa.string(), False), pa.field("position", pa.int32(), False)]
        columns += [pa.array([f"chr{r[0]:02d}" for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
    fields.append(pa.field("alleles", pa.string(), nullable))
    columns.append(pa.array([r[2] for r in rows], pa.string()))
    if sample:
        fields.append(pa.field("s", pa.string(), False))
        columns.append(pa.array([r[3] for r in rows], pa.string()))
    return pa.Table.from_arrays(columns, schema=pa.schema(fields))


def write(path, table):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path)


def samples_table(path, samples, nullable=False):
    write(path, pa.Table.from_arrays([pa.array(list(samples), pa.string())], schema=pa.schema([pa.field("s", pa.string(), nullable)])))


def single_samples(root, packed=False, samples=SAMPLES):
    for s in samples:
        for name, rows in FILES.items():
            write(f"{root}/s={s}/{name}.parquet", arrow(rows, packed))
    return str(root)


def mixed(root):
    rows = [r for f in sorted(FILES, reverse=True) for r in FILES[f]]
    write(f"{root}/g0.parquet", arrow([(*r, s) for r in rows for s in SAMPLES[:2]], sample=True))
    samples_table(f"{root}/g0.samples.parquet", SAMPLES[:2])
    for name, part in FILES.items():
        write(f"{root}/g1/{name}.parquet", arrow([(*r, SAMPLES[2]) for r in part], sample=True))
    samples_table(f"{root}/g1.samples.parquet", SAMPLES[2:3])
    single_samples(root, samples=SAMPLES[3:])
    return str(root)
