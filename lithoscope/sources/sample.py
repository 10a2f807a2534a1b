"""A small project of this library's own, for the queries and tests that need source code, and copies of it by the thousand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that copies are made and read in, whatever the number of cores that are known when a query is planned.
LEAST_TASKS = 32
FILES = {
    "/p/src/shapes.ts": """export interface Shape { area(): number; name: string }
export class Square implements Shape {
  name = 'square';
  constructor(private readonly side: number) {}
  area(): number { return this.side * this.side; }
}
export class Disc implements Shape {
  name: string = "disc"
  constructor(private r: number) {}
  area() { return 3 * this.r ** 2 }
}
""",
    "/p/src/make.ts": """import { Square, Disc } from './shapes';
import type { Shape } from './shapes';
// function commentedOut() {}
export function createShape(kind: string, size: number): Promise<Shape[]> {
  if (kind === 'square' && size > 0) {
    return Promise.resolve([new Square(size)]);
  }
  const why = kind === "disc" ? `a ${kind} of ${scale(size)}` : /di[s/]c/.test(kind) ? 'x' : 'y';
  for (const k of [1, 2]) log(why + k);
  return Promise.resolve([new Disc(size)]);
}
export const scale = async (n: number, by: number = 2) => n * by;
const log = (s: string): void => { console.log(s); };
""",
    "/p/src/store.ts": """import { EventEmitter } from 'events';
@Injectable({ scope: 'app' })
export class ShapeStore extends EventEmitter {
  private static instance: ShapeStore;
  private constructor(private api: ApiClient) { super(); }
  static getInstance(): ShapeStore { return ShapeStore.instance; }
  find(id: string) { return this.get(id); }
  save(s: Map<string, number[]>): void {}
  async delete(id: string): Promise<void> { await this.api.call(id); }
  on(e: string) {} emit(e: string) { return true }
}
""",
    "/p/src/index.ts": """export * from './shapes';
export { createShape, scale as factor } from './make';
export { ShapeStore } from './store';
""",
    "/p/src/app.tsx": """import React, { useState } from 'react';
import { createShape } from './index.js';
import { log } from '@/util';
export default function App({ title }: Props) {
  const [n, setN] = useState(0);
  return <div onClick={() => { createShape('disc', n); }}>{title}</div>;
}
export function useShapes(kind: string) { return createShape(kind, 1); }
""",
    "/p/lib/util.js": """const fs = require('fs');
exports.read = function (p) { return fs.readFileSync(p); };
module.exports.write = () => {};
function unused() { switch (fs.x) { case 1: return 1; default: return 2; } }
""",
}


def project(ids: DataFrame) -> DataFrame:
    """``path, text``: for each of ``ids(id)`` a copy of the project's sources under ``/p/<id>/src``; one ``/p/lib`` for all.

    Ids are small and the reading of their copies is not, so that partitions by size would put all of it into one task: ids
    are dealt to a number of partitions that Spark doesn't join. An id that is there twice has one copy.
    """
    spark = ids.sparkSession
    ids = ids.select("id").repartition(max(LEAST_TASKS, 3 * spark.sparkContext.defaultParallelism), "id").distinct()
    own = F.array(*[F.struct(F.lit(p.removeprefix("/p")).alias("below"), F.lit(t).alias("text")) for p, t in FILES.items() if p.startswith("/p/src/")])
    copies = ids.select("id", F.explode(own).alias("f")).select(F.concat(F.lit("/p/"), F.col("id").cast("string"), F.col("f.below")).alias("path"), F.col("f.text").alias("text"))
    shared = spark.createDataFrame([(p, t) for p, t in FILES.items() if p.startswith("/p/lib/")], "path string, text string")
    return copies.unionByName(shared)
