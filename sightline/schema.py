"""Schemas of the tables the operators exchange. Boxes are normalised to the image; absent parts are null."""

BOX = "x0 double, y0 double, x1 double, y1 double"
POINT = "struct<x: double, y: double, conf: double>"
DETECTIONS = f"stream_id long, frame_no long, t double, det_id long, cl int, conf double, {BOX}, track_id long, subbox struct<x0: double, y0: double, x1: double, y1: double, conf: double>, face_points array<{POINT}>, pose_points array<{POINT}>, attrs array<float>, reid array<float>, fiqa_score double"
GROUND_TRUTH = f"stream_id long, frame_no long, t double, gt_id long, cl string, conf double, {BOX}"
PACKETS = "stream_id long, arrival_no long, capture_time double, data binary"
NALUS = "stream_id long, nal_no long, ts90k long, codec string, data binary"
AUDIO = "stream_id long, chunk_no long, sample_rate int, num_channels int, samples array<float>"
TRACKS = f"stream_id long, frame_no long, t double, track_id long, state string, det_id long, conf double, {BOX}, observations int, missed int"

RESULT_TYPES = ["TRACK_FRAME_SKIP_FRAMERATE", "TRACK_FRAME_SKIP_NO_MOTION", "TRACK_FRAME_SKIP_NO_IMG", "TRACK_FRAME_TRACKED_ROI", "TRACK_FRAME_TRACKED_FULL_REFRESH"]
