"""Command line: download, list-windows, prepare-fused, build-from-raw, batch-export, build-map, train, evaluate."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from .operators.mixture import GmmParams
from .plans.accumulate import accumulate
from .plans.maps import export_occupied, prepare_fused, train, trained
from .session import session
from .sources import scans
from .sources.ply import files_of


def numbers(text: str | None, kind=float) -> list | None:
    return [kind(x) for x in text.replace(";", ",").split(",") if x.strip()] if text and text.strip() else None


def crop(text: str | None) -> tuple[float, ...] | None:
    box = numbers(text)
    if box is None:
        return None
    if len(box) != 6 or any(box[i] >= box[i + 1] for i in (0, 2, 4)):
        raise ValueError("a crop is xmin,xmax,ymin,ymax,zmin,zmax, each minimum below its maximum")
    return tuple(box)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridlark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in flags:
            p.add_argument(f, action="store_true")
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **v)
        return p

    must, text, real, whole = {"required": True}, {}, {"type": float}, {"type": int}
    out = dict(crop=text, voxel_size=real)
    command("download", "--force", manifest=must, root=must)
    command("list-windows", "--dynamic", "--force", root=must, sequence=must)
    command("prepare-fused", "--all-windows", "--dynamic", "--visible-only", "--xyz-only", "--xyzrgb-only", "--force", root=must, sequence=must, window=text, out=must, confidence_min=real, keep_semantic_ids=text, drop_semantic_ids=text, **out)
    command("build-from-raw", "--add-frame-field", root=must, sequence=must, start=whole, end=whole, stride={"type": int, "default": 1}, out=must, point_dim={"type": int, "default": 4}, min_range={"type": float, "default": 0.0}, max_range={"type": float, "default": float("inf")}, keep_every_nth_point={"type": int, "default": 1}, **out)
    command("batch-export", "--visible-only", "--dynamic", "--xyz-only", "--xyzrgb-only", manifest=must, root=must, out_dir=must, confidence_min=real, **out)
    command("build-map", ply=must, out=must, components={"type": int, "default": 64}, max_iter={"type": int, "default": 100}, cells={"type": int, "default": 128}, lam={"type": float, "default": 10.0}, power={"type": float, "default": 1.0}, threshold={"type": float, "default": 0.3}, fit_voxel={"type": float, "default": 0.05}, fit_points={"type": int, "default": 1_000_000}, seed={"type": int, "default": 0}, sharpen=real)
    command("train", ply=must, out=must, components={"type": int, "default": 64}, max_iter={"type": int, "default": 100}, cells={"type": int, "default": 128}, lam={"type": float, "default": 20.0}, power={"type": float, "default": 1.0}, threshold={"type": float, "default": 0.35}, fit_points={"type": int, "default": 200_000}, seed={"type": int, "default": 0})
    command("evaluate", maps=must, out=must, scenes=text, trials={"type": int, "default": 20}, iterations={"type": int, "default": 3000}, min_dist={"type": float, "default": 30.0}, max_dist={"type": float, "default": 120.0}, step={"type": float, "default": 3.0}, goal_radius={"type": float, "default": 4.0}, neighbor_radius={"type": float, "default": 10.0}, edge_step={"type": float, "default": 0.3}, lam={"type": float, "default": 10.0}, power={"type": float, "default": 1.0}, threshold={"type": float, "default": 0.35}, seed={"type": int, "default": 42})
    return top


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "download":
        spark = session()
        for r in scans.archive_manifest(spark, a.manifest).orderBy("archive").collect():
            new = scans.fetch(r["source"], os.path.join(a.root, "archives", r["archive"]), a.force)
            print(r["archive"], "fetched" if new else "there already")
        return 0
    if a.command == "list-windows":
        seq = scans.sequence_folder(a.sequence)
        scans.ensure_component(a.root, "semantics", seq, a.force)
        print("\n".join(scans.list_windows(a.root, seq, a.dynamic)))
        return 0
    spark = session()
    if a.command == "prepare-fused":
        seq = scans.sequence_folder(a.sequence)
        scans.ensure_component(a.root, "semantics", seq, a.force)
        folder = scans.windows_folder(a.root, seq, a.dynamic)
        have = scans.list_windows(a.root, seq, a.dynamic)
        wanted = have if a.all_windows else [(a.window or "").removesuffix(".ply")]
        for w in wanted:
            if w not in have:
                raise SystemExit(f"no window {w!r} of {seq}")
            target = os.path.join(a.out, f"{seq}_{w}_clean") if a.all_windows else a.out
            prepare_fused(spark, os.path.join(folder, w + ".ply"), target, crop(a.crop), a.voxel_size, a.visible_only, a.confidence_min, numbers(a.keep_semantic_ids, int), numbers(a.drop_semantic_ids, int), a.xyz_only, a.xyzrgb_only)
    elif a.command == "batch-export":
        entries = scans.batch_manifest(spark, a.manifest).orderBy("entry").collect()
        for e in entries:
            if not e["valid"]:
                print(f"entry {e['entry']}: no sequence or window, skipped")
                continue
            seq, w = scans.sequence_folder(e["sequence"]), e["window"].removesuffix(".ply")
            scans.ensure_component(a.root, "semantics", seq)
            if w not in scans.list_windows(a.root, seq, a.dynamic):
                print(f"entry {e['entry']}: no window {w}, skipped")
                continue
            source = os.path.join(scans.windows_folder(a.root, seq, a.dynamic), w + ".ply")
            box, size = crop(e["crop"] or a.crop), e["voxel_size"] if e["voxel_size"] is not None else a.voxel_size
            prepare_fused(spark, source, os.path.join(a.out_dir, f"{seq}_{w}_clean"), box, size, a.visible_only, a.confidence_min, numbers(e["keep_semantic_ids"], int), numbers(e["drop_semantic_ids"], int), a.xyz_only, a.xyzrgb_only, (f"sequence {seq}", f"window {w}"))
        print(f"{len(entries)} entries")
    elif a.command == "build-from-raw":
        from pyspark.sql import functions as F

        from .operators.poses import matrix_poses

        scans.register(spark)
        seq = scans.sequence_folder(a.sequence)
        for part in ("calibration", "poses", "raw_velodyne"):
            scans.ensure_component(a.root, part, seq)
        raw = spark.read.format("velodyne").option("point_dim", a.point_dim).load(os.path.join(a.root, "data_3d_raw", seq, "velodyne_points", "data")).withColumn("seq", F.lit(seq))
        poses = matrix_poses(scans.read_poses(spark, os.path.join(a.root, "data_poses", seq, "cam0_to_world.txt")).withColumn("seq", F.lit(seq)))
        calibration = scans.read_calibration(spark, scans.first_existing([os.path.join(a.root, "calibration")], ["calib_cam_to_velo.txt"]) or "")
        world = accumulate(raw, poses, a.start, a.end, a.stride, a.min_range, a.max_range, a.keep_every_nth_point, crop(a.crop), a.voxel_size, calibration, a.add_frame_field)
        world.select("x", "y", "z", "intensity", *(["frame"] if a.add_frame_field else [])).write.format("ply").mode("overwrite").save(a.out)
    elif a.command == "train":
        from functools import reduce

        from pyspark.sql import DataFrame
        from pyspark.sql import functions as F

        scans.register(spark)
        clouds = [spark.read.format("ply").load(f).select("pid", "x", "y", "z").withColumn("scene", F.lit(os.path.splitext(os.path.basename(f))[0])) for f in files_of(a.ply)]
        report = train(reduce(DataFrame.unionByName, clouds), a.out, GmmParams(a.components, max_iter=a.max_iter, seed=a.seed), a.cells, a.lam, a.power, a.fit_points, a.threshold, narrow=True)
        report.show(1000, truncate=False)
        trained(report).show()
    elif a.command == "evaluate":
        from .operators.planners import RrtConfig
        from .plans.experiments import SCENES, evaluate_scenes, scene_table

        own = lambda part: spark.read.parquet(f"{a.maps}/{part}")
        # --scenes label:folder:split,... ; by default the published ones
        listed = [tuple(x.split(":")) for x in a.scenes.split(",")] if a.scenes else SCENES
        rrt = RrtConfig(a.step, a.iterations, a.goal_radius, a.neighbor_radius, 0.05, a.threshold, a.edge_step)
        e = evaluate_scenes(scene_table(spark, listed), own("gmm"), own("reference"), own("grid"), rrt, a.seed, a.trials, a.min_dist, a.max_dist, a.lam, a.power, a.edge_step)
        e.trials.write.mode("overwrite").parquet(f"{a.out}/trials")
        for table in (e.scenes.orderBy("label", "planner"), e.splits.orderBy("split", "planner"), e.top):
            table.show(1000, truncate=False)
    else:
        from pyspark.sql import functions as F

        scans.register(spark)
        points = spark.read.format("ply").load(a.ply).withColumn("scene", F.lit(os.path.splitext(os.path.basename(a.ply.rstrip("/")))[0]))
        train(points, a.out, GmmParams(a.components, max_iter=a.max_iter, seed=a.seed), a.cells, a.lam, a.power, a.fit_points, a.threshold, a.fit_voxel, sharpen=a.sharpen, whole_bounds=True).show(truncate=False)
        export_occupied(spark.read.parquet(f"{a.out}/grid"), a.threshold, f"{a.out}/occupied")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
