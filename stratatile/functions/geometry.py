"""Geometry in the JVM: postfix programs of operations, run by JTS.

A program is a byte string: pushes of well-known binary and operations on the
stack, each one byte with its arguments. Programs of columns are put together
with concat(), and profiles in Python build the same bytes; the operations
themselves run only in the JVM, where Spark ships the JTS library. Its one
class is compiled, when first used, by the compiler that Spark ships for its
own generated code, and goes to the executors as a jar.
"""

from __future__ import annotations

import struct
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Operations. W: push (length and bytes follow). The others take from the stack:
#: D difference, I intersection, U union of n (n follows), B buffer (distance follows),
#: V repair, S snap to a grid (its size follows).
PUSH, DIFFERENCE, INTERSECTION, UNION, BUFFER, REPAIR, SNAP = b"WDIUBVS"

FUNCTION = "stratatile_geometry"
CLASS = "stratatile.GeometryProgram"
SOURCE = """
package stratatile;

import java.nio.ByteBuffer;
import java.util.ArrayList;
import java.util.List;
import org.locationtech.jts.geom.Geometry;
import org.locationtech.jts.geom.GeometryFactory;
import org.locationtech.jts.geom.PrecisionModel;
import org.locationtech.jts.geom.util.GeometryFixer;
import org.locationtech.jts.io.WKBReader;
import org.locationtech.jts.io.WKBWriter;
import org.locationtech.jts.operation.overlayng.OverlayNG;
import org.locationtech.jts.operation.overlayng.OverlayNGRobust;
import org.locationtech.jts.operation.union.UnaryUnionOp;
import org.locationtech.jts.precision.GeometryPrecisionReducer;

public class GeometryProgram implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object given) throws Exception {
        if (given == null) return null;
        ByteBuffer in = ByteBuffer.wrap((byte[]) given);
        GeometryFactory factory = new GeometryFactory();
        ArrayList stack = new ArrayList();
        while (in.hasRemaining()) {
            byte op = in.get();
            if (op == 'W') {
                byte[] raw = new byte[in.getInt()];
                in.get(raw);
                stack.add(new WKBReader(factory).read(raw));
            } else if (op == 'U') {
                int n = in.getInt();
                ArrayList parts = new ArrayList();
                for (int i = 0; i < n; i++) parts.add(0, pop(stack));
                Geometry all = n == 0 ? null : UnaryUnionOp.union(parts);
                stack.add(all == null ? factory.createGeometryCollection() : all);
            } else if (op == 'B') {
                double distance = in.getDouble();
                Geometry g = pop(stack);
                stack.add(g.buffer(distance, 16));
            } else if (op == 'V') {
                GeometryFixer fixer = new GeometryFixer(pop(stack));
                fixer.setKeepCollapsed(false);
                stack.add(fixer.getResult());
            } else if (op == 'S') {
                double size = in.getDouble();
                Geometry g = pop(stack);
                stack.add(g.isEmpty() ? g : GeometryPrecisionReducer.reduce(g, new PrecisionModel(1.0 / size)));
            } else if (op == 'D' || op == 'I') {
                Geometry b = pop(stack);
                Geometry a = pop(stack);
                stack.add(OverlayNGRobust.overlay(a, b, op == 'D' ? OverlayNG.DIFFERENCE : OverlayNG.INTERSECTION));
            } else {
                throw new IllegalArgumentException("no geometry operation " + op);
            }
        }
        if (stack.size() != 1) throw new IllegalArgumentException("a geometry program leaves one geometry, not " + stack.size());
        Geometry result = pop(stack);
        return result.isEmpty() ? null : new WKBWriter(2, 2).write(result);
    }

    private static Geometry pop(ArrayList stack) {
        return (Geometry) stack.remove(stack.size() - 1);
    }
}
"""


def install(spark: SparkSession) -> None:
    """Compiles and registers the function in this session, once."""
    context = spark.sparkContext
    if getattr(context, "_stratatile_geometry", None) is None:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        jar = Path(tempfile.mkdtemp()) / "stratatile-geometry.jar"
        with zipfile.ZipFile(jar, "w") as z:
            z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\n")
            made = compiler.getBytecodes()
            for name in made.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(made.get(name)))
        context._stratatile_geometry = str(jar)
    known = getattr(context, "_stratatile_sessions", set())
    session = str(spark._jsparkSession.sessionUUID())
    if session not in known:
        spark.sql(f"ADD JAR '{context._stratatile_geometry}'")
        java = spark._jsparkSession
        made = context._jvm.java.lang.Class.forName(CLASS, True, java.sharedState().jarClassLoader())
        kind = context._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
        java.udf().register(FUNCTION, made.getConstructors()[0].newInstance(context._gateway.new_array(context._jvm.java.lang.Object, 0)), kind)
        context._stratatile_sessions = known | {session}


# --- programs as bytes ------------------------------------------------------


def push(wkb: bytes) -> bytes:
    return struct.pack(">BI", PUSH, len(wkb)) + wkb


def union_of(programs: list[bytes]) -> bytes:
    return b"".join(programs) + struct.pack(">BI", UNION, len(programs))


def buffer_of(program: bytes, distance: float) -> bytes:
    return program + struct.pack(">Bd", BUFFER, distance)


def snap_of(program: bytes, size: float) -> bytes:
    return program + struct.pack(">Bd", SNAP, size)


def repair_of(program: bytes) -> bytes:
    return program + bytes([REPAIR])


def difference_of(a: bytes, b: bytes) -> bytes:
    return a + b + bytes([DIFFERENCE])


def intersection_of(a: bytes, b: bytes) -> bytes:
    return a + b + bytes([INTERSECTION])


# --- programs as columns ----------------------------------------------------


def run(program: Column) -> Column:
    """The program's result as well-known binary; null if it is empty."""
    return F.call_function(FUNCTION, program)


def pushed(wkb: Column) -> Column:
    return F.concat(F.lit(bytes([PUSH])), F.unhex(F.lpad(F.hex(F.octet_length(wkb)), 8, "0")), wkb)


def unioned(programs: Column) -> Column:
    """Union of an array of programs."""
    joined = F.aggregate(programs, F.lit(b""), lambda a, p: F.concat(a, p))
    return F.concat(joined, F.lit(bytes([UNION])), F.unhex(F.lpad(F.hex(F.size(programs)), 8, "0")))


def buffered(program: Column, distance: float) -> Column:
    return F.concat(program, F.lit(struct.pack(">Bd", BUFFER, distance)))


def snapped(program: Column, size: float = 1.0) -> Column:
    return F.concat(program, F.lit(struct.pack(">Bd", SNAP, size)))


def repaired(program: Column) -> Column:
    return F.concat(program, F.lit(bytes([REPAIR])))


def minus(a: Column, b: Column) -> Column:
    return F.concat(a, b, F.lit(bytes([DIFFERENCE])))


def crossed(a: Column, b: Column) -> Column:
    return F.concat(a, b, F.lit(bytes([INTERSECTION])))
