"""Protobuf descriptor sets as tables: methods, and message fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

METHODS = "method string, service string, input string, output string, unary boolean"
FIELDS = "message string, field string, number int, kind string, repeated boolean, type_name string"


def _messages(prefix: str, messages) -> list:
    found = []
    for m in messages:
        name = f"{prefix}.{m.name}" if prefix else m.name
        found += [(name, m), *_messages(name, m.nested_type)]
    return found


def descriptor_rows(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(methods, fields) of a serialised FileDescriptorSet; nested types count, a method that occurs twice or a group is refused."""
    from google.protobuf import descriptor_pb2 as pb

    methods, fields = {}, []
    label, kinds = pb.FieldDescriptorProto.LABEL_REPEATED, pb.FieldDescriptorProto.Type
    for file in pb.FileDescriptorSet.FromString(data).file:
        for service in file.service:
            name = f"{file.package}.{service.name}" if file.package else service.name
            for m in service.method:
                key = f"{name}/{m.name}"
                if key in methods:
                    raise ValueError(f"method {key} is there twice")
                methods[key] = (key, name, m.input_type.lstrip("."), m.output_type.lstrip("."), not (m.client_streaming or m.server_streaming))
        for name, message in _messages(file.package, file.message_type):
            for f in message.field:
                kind = kinds.Name(f.type).removeprefix("TYPE_").lower()
                if kind == "group":
                    raise ValueError(f"{name}.{f.name} is a group")
                fields.append((name, f.name, f.number, kind, f.label == label, f.type_name.lstrip(".") or None))
    return list(methods.values()), fields


def descriptor_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The methods and the message fields of a descriptor set file, which is as small as its protocol."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    methods, fields = descriptor_rows(bytes(data))
    return spark.createDataFrame(methods, METHODS), spark.createDataFrame(fields, FIELDS)


def field_table(fields: list[tuple], message: str) -> dict[str, dict]:
    """What the codec takes for a message: name to number, kind, repeated and, of a message, its own fields."""
    out = {}
    for name, field, number, kind, repeated, type_name in fields:
        if name == message:
            out[field] = {"number": number, "kind": kind, "repeated": repeated} | ({"fields": field_table(fields, type_name)} if kind == "message" else {})
    return out
